"""Operator 9: license scans by canonical digest lookup.

A text's canonical form drops what may differ between two copies of one
licence: case, punctuation, white space and wrapping, comment signs, bullets
and numbering (words such as "1.", "(a)" or "iv)"), lines that only state a
copyright (as lines of their own), and equivalent spellings. Its digest is looked up
among the digests of known licence texts by a hash join, so entire texts are
compared and one licence more costs nothing.

Defined results: null and empty texts have the digest of the empty form and
no licence; texts of any length are read whole; repeated rows and null doc_ids are scanned like any row; known
texts of one form must bear one identifier; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs
from .license_texts import LICENSE_TEXTS

#: Spellings that licence guidelines hold equivalent, as canonical words.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "noncommercial": "non commercial",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}
_PAIRS = ((b" sub license ", b" sublicense "), (b" copyright owner ", b" copyright holder "), (b" copyright owners ", b" copyright holders "), (b" non infringement ", b" noninfringement "), (b" per cent ", b" percent "))
_SIGNS = ("‘", "’", "“", "”", "–", "—", "…", "•", " ", "﻿")
_ODD = re.compile(b"|".join(s.encode() for s in _SIGNS))
_LETTERS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 or c == 10 else 32 for c in range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
#: A line that only states a copyright, after case and signs are gone.
_STATED = re.compile(rb"^ *(?:spdx filecopyrighttext +.*|portions +copyright\b.*|(?:copyright|\xc2\xa9|c) +(?:copyright +)?(?:(?:c|\xc2\xa9) +)?(?:\d{4}\b.*|year\b.*|yyyy\b.*|by +.*|c\b.*|\xc2\xa9.*)|copyright +(?:c|\xc2\xa9)\b.*|all +rights +reserved) *$", re.M)
#: A word that is a bullet: a number or letters up to its sign. Wherever it stands, since text may be wrapped anywhere.
_BULLET = re.compile(rb"(?<!\S)\(?(?:\d{1,2}|[a-zA-Z]|[ivxIVX]{1,4})[.)]+(?!\S)")
_WORDS = {a.encode(): b.encode() for a, b in SPELLINGS.items()}


def canonical(raw: bytes) -> bytes:
    """The canonical form of a UTF-8 text: words joined by single spaces."""
    text = _BULLET.sub(b" ", _ODD.sub(b" ", raw)).translate(_LETTERS)
    if b"opyright" in raw or b"OPYRIGHT" in raw or b"\xc2\xa9" in raw or b"(c)" in raw or b"(C)" in raw or b"eserved" in raw or b"ESERVED" in raw:
        text = _STATED.sub(b"", text)
    words = text.split()
    form = b" ".join(map(_WORDS.get, words, words))
    if any(pair in form for pair, _ in _PAIRS):
        for pair, same in _PAIRS:
            form = form.replace(pair, same)
    return form


def digest(raw: bytes) -> str:
    return hashlib.sha256(canonical(raw)).hexdigest()


def known_digests(texts: tuple[tuple[str, str], ...] = LICENSE_TEXTS) -> dict[str, str]:
    """Digest to identifier; two identifiers for one form are an error."""
    known: dict[str, str] = {}
    for name, text in texts:
        key = digest(text.encode())
        if known.setdefault(key, name) != name:
            raise ValueError(f"{name} and {known[key]} have one canonical form")
    return known


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, canonical_sha256, n_bytes`` of all rows; n_bytes is the size of the canonical form."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(raw) for raw in blobs(batch.column("text"))]
            columns = [batch.column("doc_id"), pa.array([hashlib.sha256(x).hexdigest() for x in forms], pa.string()), pa.array(map(len, forms), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "canonical_sha256", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, canonical_sha256 string, n_bytes long")


def scan(docs: DataFrame, texts: tuple[tuple[str, str], ...] = LICENSE_TEXTS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): canonical_sha256, n_bytes, license (null if none is known)."""
    spark = docs.sparkSession
    known = spark.createDataFrame(list(known_digests(texts).items()), "canonical_sha256 string, license string")
    return digests(docs).join(F.broadcast(known), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "n_bytes", "license")  # known texts are a fixed list
