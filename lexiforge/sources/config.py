"""Configuration of sources from a YAML file of nested maps and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _scalar(s: str):
    s = s.strip()
    if s[:1] in "'\"" and s[-1:] == s[:1] and len(s) > 1:
        return s[1:-1]
    s = s.split(" #")[0].strip()
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            continue
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(s.lower(), s)


def parse(text: str) -> dict:
    """Nested maps of scalars; lists and other YAML are refused."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        if not line.strip() or line.strip().startswith("#"):
            continue
        depth, (key, colon, value) = len(line) - len(line.lstrip()), line.strip().partition(":")
        if not colon or line.strip().startswith("- "):
            raise ValueError(f"not a map: {line.strip()}")
        while stack[-1][0] >= depth:
            stack.pop()
        if _scalar(value) is None and not value.strip():
            stack[-1][1][key] = {}
            stack.append((depth, stack[-1][1][key]))
        else:
            stack[-1][1][key] = _scalar(value)
    return root


def load(spark: SparkSession, path: str) -> dict:
    """The configuration in a file, wherever Spark can read it (it is small)."""
    return parse("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))


def sources(spark: SparkSession, config: dict) -> DataFrame:
    """(source_name, base_url, start_url, parser, max_pages) of the configured sources."""
    rows = [(s.get("name", k), s.get("base_url"), s.get("start_url"), s.get("parser"), s.get("max_pages")) for k, s in config.get("sources", {}).items()]
    return spark.createDataFrame(rows, "source_name string, base_url string, start_url string, parser string, max_pages long")
