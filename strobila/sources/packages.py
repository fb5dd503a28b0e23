"""Inputs around media files: manifests of published presentations, subtitles, and source specifications."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

_DASH = "{urn:mpeg:dash:schema:mpd:2011}"


def parse_spec(text: str) -> tuple[dict[str, str | None], str]:
    """``[+key=value,...]name`` to its options and the name; a key without value stands for itself."""
    m = re.fullmatch(r"\[([^\]]*)\](.*)", text, re.S)
    if not m:
        return {}, text
    options = {}
    for part in filter(None, m[1].split(",")):
        key, eq, value = part.partition("=")
        options[key.lstrip("+")] = value if eq else None
    return options, m[2]


def fill_template(template: str, representation: str, bandwidth: int, number: int | None = None, time: int | None = None) -> str:
    """A segment URL from a template; ``$Number%05d$`` pads."""
    values = {"RepresentationID": representation, "Bandwidth": bandwidth, "Number": number, "Time": time}

    def put(m: re.Match) -> str:
        if not m[1]:
            return "$"
        v = values[m[1]]
        return format(int(v), m[2][1:]) if m[2] else str(v)

    return re.sub(r"\$(?:(RepresentationID|Bandwidth|Number|Time)(%0\d+d)?)?\$", put, template)


def _seconds(text: str | None) -> float:
    m = re.fullmatch(r"P(?:T(?:([\d.]+)H)?(?:([\d.]+)M)?(?:([\d.]+)S)?)?", text or "")
    return sum(float(x or 0) * k for x, k in zip(m.groups(), (3600, 60, 1))) if m else 0.0


def manifest_segments(text: str) -> list[tuple[str, int, int, str]]:
    """(representation, bandwidth, number, url) of every segment of a manifest; number -1 is the initialization.

    Templates by timeline or by fixed duration, and lists of URLs.
    """
    root, out = ElementTree.fromstring(text), []
    total = _seconds(root.get("mediaPresentationDuration"))
    for period in root.iter(f"{_DASH}Period"):
        for group in period.iter(f"{_DASH}AdaptationSet"):
            for rep in group.iter(f"{_DASH}Representation"):
                name, rate = rep.get("id"), int(rep.get("bandwidth", 0))
                base = "".join((x.text or "").strip() for x in (rep.find(f"{_DASH}BaseURL"),) if x is not None)
                own, shared = rep.find(f"{_DASH}SegmentTemplate"), group.find(f"{_DASH}SegmentTemplate")
                listed = rep.find(f"{_DASH}SegmentList")
                if own is not None or shared is not None:
                    get = lambda k, d=None: next((x.get(k) for x in (own, shared) if x is not None and x.get(k) is not None), d)  # noqa: E731, B023
                    first, scale = int(get("startNumber", 1)), int(get("timescale", 1))
                    if get("initialization"):
                        out.append((name, rate, -1, base + fill_template(get("initialization"), name, rate)))
                    line = next((t for x in (own, shared) if x is not None and (t := x.find(f"{_DASH}SegmentTimeline")) is not None), None)
                    if line is not None:
                        number, time = first, 0
                        for s in line.findall(f"{_DASH}S"):
                            time = int(s.get("t", time))
                            for _ in range(int(s.get("r", 0)) + 1):
                                out.append((name, rate, number, base + fill_template(get("media"), name, rate, number, time)))
                                number, time = number + 1, time + int(s.get("d"))
                    elif get("duration"):
                        n = -(-int(total * scale) // int(get("duration")))
                        out += [(name, rate, first + k, base + fill_template(get("media"), name, rate, first + k, k * int(get("duration")))) for k in range(n)]
                elif listed is not None:
                    init = listed.find(f"{_DASH}Initialization")
                    if init is not None and init.get("sourceURL"):
                        out.append((name, rate, -1, base + init.get("sourceURL")))
                    out += [(name, rate, k + 1, base + x.get("media")) for k, x in enumerate(listed.findall(f"{_DASH}SegmentURL"))]
    return out


def read_manifests(texts: DataFrame) -> DataFrame:
    """(path, representation, bandwidth, number, url) of manifests (path, text)."""

    def work(batches):
        for pdf in batches:
            rows = [(p, *r) for p, t in zip(pdf["path"], pdf["text"]) for r in manifest_segments(t)]
            yield pd.DataFrame(rows, columns=["path", "representation", "bandwidth", "number", "url"])

    return texts.select("path", "text").mapInPandas(work, "path string, representation string, bandwidth long, number long, url string")


def _clock(text: str) -> int | None:
    m = re.fullmatch(r"(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})", text.strip())
    if m:
        return ((int(m[1] or 0) * 60 + int(m[2])) * 60 + int(m[3])) * 1000 + int(m[4].ljust(3, "0"))
    m = re.fullmatch(r"([\d.]+)(ms|s|m|h)", text.strip())
    return round(float(m[1]) * {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}[m[2]]) if m else None


def subtitle_cues(text: str) -> list[tuple[str, int, int, str]]:
    """(format, begin, end, text) of cues, times in milliseconds; WebVTT or TTML, by the beginning of the text."""
    plain = text.lstrip("﻿")
    if plain.startswith("WEBVTT"):
        out = []
        for block in re.split(r"\r?\n\r?\n+", plain)[1:]:
            lines = block.splitlines()
            for k, line in enumerate(lines):
                begin, arrow, rest = line.partition("-->")
                if arrow:
                    times = _clock(begin), _clock(rest.split()[0] if rest.split() else "")
                    if None not in times:
                        out.append(("webvtt", *times, "\n".join(lines[k + 1 :])))
                    break
        return out
    if plain.lstrip().startswith("<"):
        root = ElementTree.fromstring(plain.strip())
        if root.tag.endswith("}tt") or root.tag == "tt":
            out = []
            for p in root.iter():
                if p.tag.rpartition("}")[2] == "p" and p.get("begin"):
                    begin = _clock(p.get("begin"))
                    end = _clock(p.get("end")) if p.get("end") else begin + (_clock(p.get("dur") or "0s") or 0)
                    out.append(("ttml", begin, end, "".join(p.itertext()).strip()))
            return out
    return []


def read_subtitles(texts: DataFrame) -> DataFrame:
    """(path, cue_index, format, begin, end, text) of subtitle files (path, text); others have no cues."""

    def work(batches):
        for pdf in batches:
            rows = [(p, k, *c) for p, t in zip(pdf["path"], pdf["text"]) for k, c in enumerate(subtitle_cues(t))]
            yield pd.DataFrame(rows, columns=["path", "cue_index", "format", "begin", "end", "text"])

    return texts.select("path", "text").mapInPandas(work, "path string, cue_index long, format string, begin long, end long, text string")
