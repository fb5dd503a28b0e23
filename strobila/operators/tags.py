"""Metadata entries: reading item lists, and listing, adding and removing tags as joins on entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a data box's type code means.
TEXT, INTEGER = (1,), (21, 22)


def from_items(items: DataFrame) -> DataFrame:
    """``items`` (file, key, ordinal, payload of the item box) to metadata entries, one for each data box."""
    schema = "file string, namespace string, key string, ordinal int, type_code int, language int, value_binary binary, value_string string, value_long long"

    def work(batches):
        import pandas as pd

        from strobila.sources.boxes import header

        for pdf in batches:
            rows = []
            for file, key, ordinal, payload in zip(pdf["file"], pdf["key"], pdf["ordinal"], pdf["payload"]):
                data, at, space, name, found = bytes(payload), 0, "meta", key, []
                while (h := header(data, at, len(data))) is not None:
                    kind, head, size = h
                    body = data[at + head : at + size]
                    if kind == "mean":
                        space = body[4:].decode("utf-8", "replace")
                    elif kind == "name":
                        name = body[4:].decode("utf-8", "replace")
                    elif kind == "data":
                        found.append((int.from_bytes(body[1:4], "big"), int.from_bytes(body[4:8], "big"), body[8:]))
                    at += size
                for code, language, value in found:
                    text = value.decode("utf-8", "replace") if code in TEXT else None
                    number = int.from_bytes(value, "big", signed=code == 21) if code in INTEGER and 0 < len(value) <= 8 else None
                    rows.append((file, space, name, int(ordinal), code, language, value, text, number))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out["value_long"] = out["value_long"].astype("Int64")
            yield out

    return items.mapInPandas(work, schema)


def read_tags(atoms: DataFrame) -> DataFrame:
    items = atoms.filter(F.col("path").rlike(r"/ilst\[0\]/[^/]+$")).select("file", F.col("type").alias("key"), "ordinal", "payload")
    return from_items(items)


def remove_tags(tags: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the entries of (file, namespace, key)."""
    return tags.join(gone.select("file", "namespace", "key").distinct(), ["file", "namespace", "key"], "left_anti")


def add_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """With ``new`` entries in place of those of the same file, namespace and key."""
    return remove_tags(tags, new).unionByName(new)


def item_bytes(key: str, values: list[tuple[int, bytes]], namespace: str | None = None) -> bytes:
    """An item box; with ``namespace`` a reserved one."""
    from strobila.sources.writers import box, full_box

    data = [box("data", code.to_bytes(4, "big"), bytes(4), value) for code, value in values]
    if namespace is None:
        return box(key, *data)
    return box("----", full_box("mean", 0, 0, namespace.encode()), full_box("name", 0, 0, key.encode()), *data)
