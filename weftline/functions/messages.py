"""Messages in a reader's language: a map per message, English where one lacks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ("en", "tr", "es", "de", "fr")
# Own wordings of the messages that the job's rows need.
MESSAGES: dict[str, dict[str, str]] = {
    "unknown_format": {"en": "{file}: unknown format", "de": "{file}: unbekanntes Format", "fr": "{file} : format inconnu", "es": "{file}: formato desconocido", "tr": "{file}: bilinmeyen biçim"},
    "no_target": {"en": "{file}: no target format", "de": "{file}: kein Zielformat", "fr": "{file} : pas de format cible", "es": "{file}: sin formato de destino", "tr": "{file}: hedef biçim yok"},
    "no_route": {"en": "{file}: can't become {target}", "de": "{file}: nicht nach {target} umwandelbar", "fr": "{file} : pas de conversion vers {target}", "es": "{file}: no se convierte a {target}", "tr": "{file}: {target} olamaz"},
    "engine_missing": {"en": "{file}: needs {engines}", "de": "{file}: braucht {engines}", "fr": "{file} : nécessite {engines}", "es": "{file}: necesita {engines}", "tr": "{file}: {engines} gerekir"},
    "engine_failed": {"en": "{file}: {engines} failed", "de": "{file}: {engines} ist gescheitert", "fr": "{file} : échec de {engines}", "es": "{file}: falló {engines}", "tr": "{file}: {engines} başarısız"},
    "too_large": {"en": "{file}: too large", "de": "{file}: zu groß", "fr": "{file} : trop volumineux", "es": "{file}: demasiado grande", "tr": "{file}: çok büyük"},
    "read_failed": {"en": "{file}: can't be read", "de": "{file}: nicht lesbar", "fr": "{file} : illisible", "es": "{file}: no se puede leer", "tr": "{file}: okunamıyor"},
    "write_failed": {"en": "{file}: can't be written", "de": "{file}: nicht schreibbar", "fr": "{file} : écriture impossible", "es": "{file}: no se puede escribir", "tr": "{file}: yazılamıyor"},
    "convert_failed": {"en": "{file}: can't be converted", "de": "{file}: nicht umwandelbar", "fr": "{file} : conversion impossible", "es": "{file}: no se puede convertir", "tr": "{file}: dönüştürülemiyor"},
    "bad_options": {"en": "{file}: a setting is out of range", "de": "{file}: eine Einstellung ist unzulässig", "fr": "{file} : réglage hors limites", "es": "{file}: ajuste fuera de rango", "tr": "{file}: ayar sınır dışında"},
    "cancelled": {"en": "{file}: out of time", "de": "{file}: Zeit abgelaufen", "fr": "{file} : temps écoulé", "es": "{file}: sin tiempo", "tr": "{file}: süre doldu"},
}


def locale_language(locale: Column) -> Column:
    """The language of a locale among LANGUAGES, else English."""
    first = F.lower(F.regexp_extract(F.coalesce(locale, F.lit("")), r"\A\s*([A-Za-z]+)", 1))
    return F.when(first.isin(*LANGUAGES), first).otherwise("en")


def message(code: Column, locale: Column, values: Mapping[str, Column]) -> Column:
    """A code's message in the locale's language with {names} filled in."""
    table = F.create_map(*[F.lit(x) for k, m in MESSAGES.items() for lang in LANGUAGES for x in (f"{k}/{lang}", m.get(lang, m["en"]))])
    text = F.try_element_at(table, F.concat(code, F.lit("/"), locale_language(locale)))
    for name, value in values.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), F.coalesce(value, F.lit("")))
    return text


def placeholders(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{([a-z_]+)\}"), 1)))
