"""Payloads to canonical JSON text: JSON stays as it is, XML and YAML are converted.

XML: attributes are ``@name``, text beside attributes or children is ``#text``, a repeated
child is a list, an empty element is null. Bad payloads give null, never an error.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.scalars import detect_format

Parser = Callable[[str], Any]


def parse_json(content: str) -> Any:
    return json.loads(content)


def parse_xml(content: str) -> Any:
    spaces: dict[str, str] = {}

    def name(tag: str) -> str:
        if not tag.startswith("{"):
            return tag
        uri, _, local = tag[1:].partition("}")
        prefix = spaces.get(uri, "")
        return f"{prefix}:{local}" if prefix else local

    def value(element: ET.Element) -> Any:
        out: dict[str, Any] = {f"@{name(k)}": v for k, v in element.attrib.items()}
        for child in element:
            key, inner = name(child.tag), value(child)
            if key not in out:
                out[key] = inner
            elif isinstance(out[key], list):
                out[key].append(inner)
            else:
                out[key] = [out[key], inner]
        text = (element.text or "").strip() + "".join((c.tail or "").strip() for c in element)
        if not out:
            return text or None
        if text:
            out["#text"] = text
        return out

    parser = ET.XMLPullParser(("start-ns", "end"))
    parser.feed(content)
    parser.close()
    root = None
    for event, item in parser.read_events():
        if event == "start-ns":
            spaces[item[1]] = item[0]
        else:
            root = item
    return {name(root.tag): value(root)}


def parse_yaml(content: str) -> Any:
    import yaml

    return yaml.safe_load(content)


PARSERS: dict[str, Parser] = {"json": parse_json, "xml": parse_xml, "yaml": parse_yaml, "yml": parse_yaml}


def to_json_text(content: Column, fmt: Column, additional: Mapping[str, Parser] | None = None) -> Column:
    """Canonical JSON text of a payload; null for unknown formats and payloads that don't parse."""
    parsers = {**PARSERS, **(additional or {})}

    @F.pandas_udf("string")
    def convert(contents: pd.Series, formats: pd.Series) -> pd.Series:
        def one(text: str | None, kind: str | None) -> str | None:
            parser = parsers.get(kind or "")
            if text is None or parser is None:
                return None
            try:
                return json.dumps(parser(text), ensure_ascii=False, default=str)
            except Exception:  # a bad payload is a null row, whatever a custom parser raises
                return None

        return pd.Series([one(t, k) for t, k in zip(contents, formats, strict=True)], dtype=object)

    return F.when(fmt == "json", F.when(F.try_parse_json(content).isNotNull(), content)).otherwise(convert(content, fmt))


def parse_pages(pages: DataFrame, content: str = "content", content_type: str = "content_type", fmt: str | None = None, additional: Mapping[str, Parser] | None = None) -> DataFrame:
    """Replaces the payload by JSON text; ``fmt`` overrides what the content type says."""
    return pages.withColumn(content, to_json_text(F.col(content), F.lit(fmt) if fmt else detect_format(F.col(content_type)), additional))


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: path, content, and whether it is JSON."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return files.withColumn("is_json", F.try_parse_json("content").isNotNull())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_json(frame: DataFrame, path: str, *, append: bool = False) -> None:
    frame.write.mode("append" if append else "overwrite").json(path)


# --- rebuilt responses ---


def rebuilt(frame: DataFrame) -> DataFrame:
    """Status from status_code or a numeric status, the longest of the content candidates, a reason."""
    have = set(frame.columns)
    pick = lambda names: [F.col(n).cast("string") for n in names if n in have]
    codes = [c.try_cast("int") for c in pick(("status_code", "status"))]
    contents = pick(("content", "_content", "json", "text"))
    longest = F.element_at(F.array_sort(F.filter(F.array(*contents), lambda c: c.isNotNull()), lambda a, b: F.length(b) - F.length(a)), 1) if contents else F.lit(None).cast("string")
    code = F.coalesce(*codes) if codes else F.lit(None).cast("int")
    reason = F.coalesce(*pick(("reason", "status")), F.when(code.between(200, 299), "OK").when(code >= 400, "Error"))
    return frame.withColumn("_s", code).withColumn("_r", reason).withColumn("_c", longest).drop("status_code", "reason", "content").withColumnsRenamed({"_s": "status_code", "_r": "reason", "_c": "content"})


def is_valid_response(code: Column, url: Column, reason: Column, content: Column) -> Column:
    from foliospark.functions.scalars import valid_url

    return F.coalesce(code.between(100, 599), F.lit(False)) & valid_url(url) & reason.isNotNull() & content.isNotNull()
