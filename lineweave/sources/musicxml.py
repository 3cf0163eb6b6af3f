"""Notes out of compressed or plain MusicXML scores, read through the binary file source."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "path string, part_id string, part_name string, instrument_name string, percussion boolean, voice_id string, measure int, "
    "o double, d double, p int, v int, tie string, error string"
)
# Semitones of the note names.
_STEP = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def _xml(content: bytes) -> bytes:
    if content[:2] != b"PK":
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if "META-INF/container.xml" in names:
            box = ElementTree.fromstring(z.read("META-INF/container.xml"))
            for e in box.iter():
                if e.tag.rpartition("}")[2] == "rootfile" and e.get("full-path") in names:
                    return z.read(e.get("full-path"))
        return z.read(next(n for n in names if n.endswith((".xml", ".musicxml")) and not n.startswith("META-INF")))


def notes(content: bytes) -> list[tuple]:
    """Rows of (part_id, part_name, instrument_name, percussion, voice_id, measure, o, d, p, v, tie) with absolute onsets in quarters."""
    root = ElementTree.fromstring(_xml(content))
    about = {}
    for sp in root.iter("score-part"):
        channel = sp.findtext("midi-instrument/midi-channel")
        about[sp.get("id")] = (sp.findtext("part-name"), sp.findtext("score-instrument/instrument-name"), channel == "10")
    out = []
    for part in root.iter("part"):
        name, instrument, drums = about.get(part.get("id"), (None, None, False))
        start, per = 0.0, 1.0
        for k, measure in enumerate(part.iter("measure"), 1):
            number = measure.get("number", "")
            number = int(number) if number.isdigit() else k
            at, furthest, last = 0.0, 0.0, 0.0
            for e in measure:
                if e.tag == "attributes" and e.findtext("divisions"):
                    per = float(e.findtext("divisions"))
                elif e.tag in ("backup", "forward"):
                    at += float(e.findtext("duration", "0")) / per * (-1 if e.tag == "backup" else 1)
                elif e.tag == "note":
                    d = float(e.findtext("duration", "0")) / per
                    begin = last if e.find("chord") is not None else at
                    pitch = e.find("pitch")
                    if pitch is not None and e.find("grace") is None:
                        p = _STEP[pitch.findtext("step")] + round(float(pitch.findtext("alter", "0"))) + 12 * (int(pitch.findtext("octave")) + 1)
                        kinds = {t.get("type") for t in e.findall("tie")}
                        tie = "continue" if kinds >= {"start", "stop"} else next(iter(kinds), None)
                        percussion = drums or e.find("unpitched") is not None
                        out.append((part.get("id"), name, instrument, percussion, e.findtext("voice"), number, start + begin, d, p, 80, tie))
                    if e.find("chord") is None:
                        last = at
                        at += d
                furthest = max(furthest, at)
            start += furthest
    return out


def read_scores(spark: SparkSession, path: str, glob: str = "*.{mxl,xml,musicxml}") -> DataFrame:
    """One row per note of all scores under path; a file that can't be read is one row with an error and no note."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(p, *n, None) for n in notes(bytes(content))]
                except Exception as e:  # noqa: BLE001  a broken file is a row of its own
                    rows.append((p, *[None] * 11, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=columns).astype({"measure": "Int32", "p": "Int32", "v": "Int32", "percussion": "boolean"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(parse, SCHEMA)
