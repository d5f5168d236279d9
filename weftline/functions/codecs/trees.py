"""Trees of null, boolean, number, text, list and mapping: JSON, YAML, XML, TOML; and tables."""

from __future__ import annotations

import csv
import io
import json
import math
import re
from datetime import date, datetime, time
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from . import Unreadable

DEPTH = 512
#: Scalars that YAML 1.2's core schema doesn't read as text.
NOT_TEXT = re.compile(
    r"\A(?:|~|null|Null|NULL|true|True|TRUE|false|False|FALSE|[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+|[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?"
    r"|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)|[0-9]{4}-[0-9]{2}-[0-9]{2}.*)\Z",
    re.S,
)


def plain(v: Any) -> Any:
    """The tree with text keys and without dates."""
    if isinstance(v, dict):
        return {k if isinstance(k, str) else cell(k): plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (datetime, date, time)):
        return v.isoformat()
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return int(v)
    return v


def number(v: int | float) -> str:
    """A number without exponent or needless zeros."""
    if isinstance(v, int):
        return str(v)
    if not math.isfinite(v):
        return str(v)
    if v == int(v):
        return str(int(v))
    text = repr(v)
    return format(v, "f").rstrip("0") if "e" not in text else f"{v:.340f}".rstrip("0") if abs(v) < 1 else text


def cell(v: Any) -> str:
    """A value as one table cell."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v) if isinstance(v, float) and "e" not in repr(v) and not v.is_integer() else number(v)
    if isinstance(v, str):
        return v
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def text_of(raw: bytes) -> str:
    return raw.decode("utf-8-sig", "replace")


def read_json(raw: bytes) -> Any:
    """The first value of the content; integers keep all their digits."""
    try:
        return plain(json.JSONDecoder().raw_decode(text_of(raw).lstrip())[0])
    except ValueError as e:
        raise Unreadable(str(e)) from None


def write_json(v: Any) -> bytes:
    return (json.dumps(v, ensure_ascii=False, indent=2) + "\n").encode()


def read_yaml(raw: bytes) -> Any:
    import yaml

    class Core(yaml.SafeLoader):
        """Booleans are true and false only, as in YAML 1.2."""

    Core.yaml_implicit_resolvers = {
        k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:value")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    Core.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"\A(?:true|True|TRUE|false|False|FALSE)\Z"), list("tTfF"))
    try:
        return plain(yaml.load(text_of(raw), Loader=Core))  # noqa: S506  a safe loader
    except yaml.YAMLError as e:
        raise Unreadable(str(e)) from None


def _yaml_text(s: str) -> str:
    quote = NOT_TEXT.match(s) or s != s.strip() or re.search(r"[\x00-\x1f\x7f\"\\]|: |:\Z| #", s) or s[0] in "-?:,[]{}#&*!|>'%@`" or s.lower() in ("yes", "no", "on", "off", "y", "n")
    return json.dumps(s, ensure_ascii=False) if quote else s


def write_yaml(v: Any, depth: int = 0) -> bytes:
    return ("\n".join(_yaml_lines(v, 0)) + "\n").encode()


def _yaml_lines(v: Any, depth: int) -> list[str]:
    pad = "  " * depth
    if isinstance(v, dict) and v:
        out = []
        for k, x in v.items():
            if isinstance(x, (dict, list)) and x:
                out += [f"{pad}{_yaml_text(k)}:", *_yaml_lines(x, depth + 1)]
            else:
                out.append(f"{pad}{_yaml_text(k)}: {_yaml_lines(x, 0)[0]}")
        return out
    if isinstance(v, list) and v:
        out = []
        for x in v:
            inner = _yaml_lines(x, depth + 1)
            out += [f"{pad}- {inner[0].lstrip()}", *inner[1:]]
        return out
    if isinstance(v, str):
        return [pad + _yaml_text(v)]
    return [pad + {None: "null", True: "true", False: "false"}[v] if v is None or isinstance(v, bool) else pad + ("{}" if v == {} else "[]" if v == [] else cell(v))]


def xml_name(name: str) -> str:
    out = re.sub(r"[^\w.\-]", "_", re.sub(r"\A[^\w]+|\A[\d.\-]+", "", name))
    out = re.sub(r"\A[\d.\-]+", "", out) or "item"
    return f"_{out}" if out.lower().startswith("xml") else out


def write_xml(v: Any) -> bytes:
    """Sorted elements under ``root``; lists repeat an element, at the top ``item``."""

    def lines(name: str, v: Any, depth: int) -> list[str]:
        pad = "  " * depth
        if isinstance(v, dict):
            inner = [x for k in sorted(v) for x in lines(xml_name(k), v[k], depth + 1)]
            return [f"{pad}<{name}>", *inner, f"{pad}</{name}>"]
        if isinstance(v, list):
            if depth == 0:
                return [f"<{name}>", *(x for i in v for x in lines("item", i, 1)), f"</{name}>"]
            return [x for i in v for x in lines(name, i, depth)]
        if v is None:
            return [f"{pad}<{name}/>"]
        return [f"{pad}<{name}>{escape(cell(v), {chr(34): '&#34;', chr(39): '&#39;'})}</{name}>"]

    return ('<?xml version="1.0" encoding="UTF-8"?>\n' + "\n".join(lines("root", v, 0)) + "\n").encode()


def read_xml(raw: bytes) -> Any:
    """Attributes are @name, text beside children #text, repeated names lists; a
    root called ``root`` is unwrapped, one of items only is a list."""
    local = lambda t: t.rpartition("}")[2]

    try:
        root = ElementTree.fromstring(re.sub(r"\A\s*<\?xml[^>]*\?>", "", text_of(raw)))
    except ElementTree.ParseError as e:
        raise Unreadable(str(e)) from None

    def build(e: ElementTree.Element, depth: int = 0) -> Any:
        if depth > DEPTH:
            raise Unreadable("too deep")
        out: dict[str, Any] = {f"@{local(k)}": v for k, v in e.attrib.items()}
        several: dict[str, list[Any]] = {}
        for c in e:
            several.setdefault(local(c.tag), []).append(build(c, depth + 1))
        out |= {k: v[0] if len(v) == 1 else v for k, v in several.items()}
        text = ((e.text or "") + "".join(c.tail or "" for c in e)).strip()
        if not out:
            return text
        return out | ({"#text": text} if text else {})

    value = build(root)
    if local(root.tag) != "root":
        return {local(root.tag): value}
    if isinstance(value, dict) and set(value) == {"item"}:
        return value["item"] if isinstance(value["item"], list) else [value["item"]]
    return value


def read_toml(raw: bytes) -> Any:
    import tomllib

    try:
        return plain(tomllib.loads(text_of(raw).replace("\r\n", "\n")))
    except tomllib.TOMLDecodeError as e:
        raise Unreadable(str(e)) from None


def write_toml(v: Any) -> bytes:
    """A root that isn't a mapping goes under ``value``; nulls are dropped."""

    def drop(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: drop(y) for k, y in x.items() if y is not None}
        return [drop(y) for y in x if y is not None] if isinstance(x, list) else x

    def key(k: str) -> str:
        return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k, ensure_ascii=False)

    def value(x: Any) -> str:
        if isinstance(x, dict):
            return "{" + ", ".join(f"{key(k)} = {value(y)}" for k, y in x.items()) + "}"
        if isinstance(x, list):
            return "[" + ", ".join(map(value, x)) + "]"
        if isinstance(x, str):
            return json.dumps(x, ensure_ascii=False).replace("\x7f", "\\u007f")
        if isinstance(x, float):
            return {math.inf: "inf", -math.inf: "-inf"}.get(x, "nan" if x != x else repr(x))
        return cell(x)

    def lines(t: dict[str, Any], path: str) -> list[str]:
        tables = {k: x for k, x in t.items() if isinstance(x, dict)}
        lists = {k: x for k, x in t.items() if isinstance(x, list) and x and all(isinstance(y, dict) for y in x)}
        out = [f"{key(k)} = {value(x)}" for k, x in t.items() if k not in tables and k not in lists]
        for k, x in tables.items():
            out += ["", f"[{path}{key(k)}]", *lines(x, f"{path}{key(k)}.")]
        for k, x in lists.items():
            for y in x:
                out += ["", f"[[{path}{key(k)}]]", *lines(y, f"{path}{key(k)}.")]
        return out

    root = drop(v)
    return ("\n".join(lines(root if isinstance(root, dict) else {"value": root}, "")).lstrip("\n") + "\n").encode()


# ---- tables


def read_delimited(raw: bytes, delimiter: str) -> list[list[str]]:
    csv.field_size_limit(1 << 27)
    try:
        return [r for r in csv.reader(io.StringIO(text_of(raw), newline=""), delimiter=delimiter) if r]
    except csv.Error as e:
        raise Unreadable(str(e)) from None


def write_delimited(rows: list[list[str]], delimiter: str) -> bytes:
    must, may = re.compile(rf'[{delimiter}"\r\n]|\A\s|\A\\\.\Z'), re.compile(r'["\s\\]')
    one = lambda c: '"' + c.replace('"', '""') + '"' if must.search(c) else c
    out = []
    for r in rows:
        line = "".join(r)
        out.append(delimiter.join(map(one, r) if delimiter in line or may.search(line) else r))
    return "".join(x + "\n" for x in out).encode()


def records(rows: list[list[str]]) -> list[dict[str, str]]:
    if not rows:
        return []
    names = [h or f"col{i + 1}" for i, h in enumerate(rows[0])]
    return [{n: r[i] if i < len(r) else "" for i, n in enumerate(names)} for r in rows[1:]]


def rows_of(v: Any) -> list[list[str]]:
    """A tree as a table: a list of mappings, a list of lists or one mapping."""
    items = [v] if isinstance(v, dict) else v
    if not isinstance(items, list) or items and not isinstance(items[0], (dict, list)):
        raise Unreadable("not tabular")
    if items and isinstance(items[0], list):
        if not all(isinstance(x, list) for x in items):
            raise Unreadable("not tabular")
        return [list(map(cell, x)) for x in items]
    if not all(isinstance(x, dict) for x in items):
        raise Unreadable("not tabular")
    names = list(dict.fromkeys(k for x in items for k in sorted(x)))
    return [names, *([cell(x.get(k)) for k in names] for x in items)] if names else []


TREE_READERS = {"json": read_json, "yaml": read_yaml, "xml": read_xml, "toml": read_toml}
TREE_WRITERS = {"json": write_json, "yaml": write_yaml, "xml": write_xml, "toml": write_toml}
