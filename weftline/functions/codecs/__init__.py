"""Stateful parsers and binary codecs: functions of one file's content, run in Arrow batches."""


class Unreadable(ValueError):
    """The content isn't what its format says."""
