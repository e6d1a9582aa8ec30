"""Fill-in-the-middle: texts cut at token boundaries into prefix, middle and suffix, and put in another order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import parts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, SPM, PSM = "plain", "spm", "psm"
#: Per cent of texts that are cut, and per cent of those whose suffix comes first.
RATE, SPM_SHARE, SEED = 50, 80, 42
CUT = "fim_tokens long, fim_form string, fim_prefix_chars long, fim_middle_chars long, fim_output string"


def boundaries(points: np.ndarray) -> np.ndarray:
    """Places between tokens of a text's code points, with both ends; an empty text has the one place 0.

    A token is a word with the blanks before it, or the blanks at the end. So one begins wherever a
    blank follows what is none.
    """
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    inner = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, "int64")


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The four numbers that decide a document's cut, from its id; a null id is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def piece(points: np.ndarray, a: int, b: int) -> str:
    return points[a:b].tobytes().decode("utf-32-le")


def cut(doc_id: int | None, text: str, rate: int, spm_share: int, seed: int) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, prefix characters, middle characters, output) of a text."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    places = boundaries(points)
    n = len(places) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return n, PLAIN, None, None, text
    a, b = (int(places[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = piece(points, 0, a), piece(points, a, b), piece(points, b, len(points))
    if h4 % 100 < spm_share:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str | None, form: str | None) -> str | None:
    """The text of an output. Texts hold no marks where they are cut, and no mark overlaps another, so each is found at its place."""
    if output is None or form not in (SPM, PSM):
        return output
    first, second = (SUFFIX, PREFIX) if form == SPM else (PREFIX, SUFFIX)
    head, rest = output.removeprefix(first).split(second, 1)
    tail, middle = rest.split(MIDDLE, 1)
    return tail + middle + head if form == SPM else head + middle + tail


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_share: int = SPM_SHARE, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, ...) with fim_tokens, fim_form, fim_prefix_chars, fim_middle_chars and fim_output.

    A text is cut after two numbers of tokens that follow from seed and doc_id alone, so equal rows
    and reruns give equal results. It stays plain if it is empty (null counts as that), holds a mark or
    is not drawn; prefix and middle are then null. Rows pass one by one, so repeated and null ids, ties
    and very long texts need no care, and columns named like the new ones are replaced. No shuffle.
    """
    added = T.StructType.fromDDL(CUT)
    rows = docs.drop(*added.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", 4096):
                ids = part.column("doc_id").to_pylist()
                found = [cut(i, text or "", rate, spm_share, seed) for i, text in zip(ids, part.column("text").to_pylist(), strict=True)]
                new = [pa.array(c, pa.string() if k in (1, 4) else pa.int64()) for k, c in enumerate(zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *added.names])

    return rows.mapInArrow(run, T.StructType(rows.schema.fields + added.fields))


def restore_middle(cuts: DataFrame, column: str = "restored") -> DataFrame:
    """Rows of fill_in_middle with the text rebuilt from fim_output and fim_form alone."""
    rows = cuts.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "fim_output", 4096):
                texts = map(rebuilt, part.column("fim_output").to_pylist(), part.column("fim_form").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, column])

    return rows.mapInArrow(run, T.StructType(rows.schema.fields + [T.StructField(column, T.StringType())]))


def digests(cuts: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of fill_in_middle's rows."""
    found = restore_middle(cuts.select(F.col("doc_id").cast("long").alias("doc_id"), *T.StructType.fromDDL(CUT).names))
    sha = lambda c, name: F.sha2(F.col(c).cast("binary"), 256).alias(name)
    return found.select(
        "doc_id", F.col("fim_tokens").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"), sha("fim_output", "output_sha256"), sha("restored", "restored_sha256"),
    )
