"""Sentences of texts, chunks of sentences, and the part of a text that fits a topic.

Sentences end where the Unicode text segmentation rules (UAX #29, sentence
boundaries) say: a full stop does not end one before a digit, between capitals,
or where the text goes on in lower case; quotes, brackets and spaces behind a
terminator belong to it; a line break always ends one. Every character becomes the
letter of its class, and one regular expression over those letters finds the
sentences, so a long text costs one pass. All positions are bytes of the UTF-8
text.

Spark hands whole Arrow batches of texts to these functions; each text is cut by
itself.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Characters of the classes that general categories do not tell.
FULL_STOPS = ".․﹒．"
TERMINATORS = "!?։؝؞؟۔܀܁܂߹࠷࠹࠽࠾।॥၊။።፧፨᙮᜵᜶᠃᠉᥄᥅᪨᪩᪪᪫᭚᭛᭞᭟᰻᰼᱾᱿‼‽⁇⁈⁉⸮⸼。꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫﹖﹗！？｡"
CONTINUERS = ",-:;՝،؍߸᠂᠈–—、︐︑︓︱︲﹐﹑﹕﹘﹣，－：､"

#: Bytes of a chunk, sentences carried over, and bytes of a text below which it is one span.
CHUNK, OVERLAP, LEAST = 2048, 1, 512


def kind(c: str) -> str:
    """Class of a character: U L O letters, N digit, A full stop, S other terminator, C quote or bracket, P space, R F E breaks, T continues, X extends, Z other."""
    if c in FULL_STOPS:
        return "A"
    if c in TERMINATORS:
        return "S"
    if c in CONTINUERS:
        return "T"
    if c == "\r":
        return "R"
    if c == "\n":
        return "F"
    if c in "\x85  ":
        return "E"
    if c.isspace():
        return "P"
    category = unicodedata.category(c)
    if category in ("Mn", "Me", "Mc", "Cf"):
        return "X"
    if c.isupper() or category == "Lt":
        return "U"
    if c.islower():
        return "L"
    if category[0] == "L" or category == "Nl":
        return "O"
    if category == "Nd":
        return "N"
    return "C" if category in ("Ps", "Pe", "Pi", "Pf") or c in "\"'" else "Z"


class _Kinds(dict):
    """Translation table that is filled as characters are met."""

    def __missing__(self, code: int) -> str:
        self[code] = k = kind(chr(code))
        return k


_KINDS = _Kinds()
_END = "(?:[AS]C*+P*+(?:RF|[RFE])?|RF|[RFE])"
_SENTENCE = re.compile(f"(?:[^ASRFE]++|A(?=N)|(?<=[UL])A(?=U)|AC*+P*+(?=[^OULRFEAS]*+L)|[AS]C*+P*+(?=[TAS]))++{_END}?|{_END}")
_LED = re.compile("(?:(?<=[RFE])|^)X+")


def _each(text: str) -> Iterator[tuple[int, int]]:
    kinds = _LED.sub(lambda m: "Z" * len(m[0]), text.translate(_KINDS))
    places = None
    if "X" in kinds:
        # what extends a character goes with it
        places = [i for i, k in enumerate(kinds) if k != "X"] + [len(kinds)]
        kinds = kinds.replace("X", "")
    for m in _SENTENCE.finditer(kinds):
        a, b = m.span() if places is None else (places[m.start()], places[m.end()])
        if any(c.isalnum() for c in text[a:b]):
            yield a, b


def spans(text: str) -> list[tuple[int, int]]:
    """Bounds, in characters, of the sentences that hold a letter or digit."""
    return list(_each(text))


def sentences(text: str) -> list[str]:
    return [text[a:b] for a, b in spans(text)]


def chunk_sentences(parts: list[str], size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Runs of sentences of at most ``size`` bytes (one sentence at least), each led by the last ``overlap`` of the one before; none if all fit one run."""
    lengths = [len(p.encode()) for p in parts]
    out, first, held = [], 0, 0
    for i, n in enumerate(lengths):
        if held + n > size and i > first:
            out.append((first, i))
            first = max(first, i - overlap)
            held = sum(lengths[first:i])
        held += n
    if parts:
        out.append((first, len(parts)))
    return out if len(out) > 1 else []


def topic_of(text: str, most: int = 60) -> str:
    """First sentence, cut to ``most`` bytes with '...', between characters."""
    a, b = next(_each(text), (0, 0))
    first = text[a:b].strip()
    raw = first.encode()
    return first if len(raw) <= most else raw[: most - 3].decode(errors="ignore") + "..."


def chunks_of(text: str, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> list[dict]:
    """Chunks with their bytes in the text and a header that names the topic; none for short texts."""
    if len(text.encode()) < least:
        return []
    own = spans(text)
    parts = [text[a:b] for a, b in own]
    runs = chunk_sentences(parts, size, overlap)
    topic = topic_of(text) if runs else ""
    at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]) if runs and not text.isascii() else range(len(text) + 1)
    return [{"place": i, "total": len(runs), "start": int(at[own[a][0]]), "end": int(at[own[b - 1][1]]), "header": f'[From: "{topic}", part {i + 1}/{len(runs)}]\n', "chunk": "".join(parts[a:b])} for i, (a, b) in enumerate(runs)]


# ---------------------------------------------------------------- spans by topic

_WORD = re.compile(r"[^\W_]+")
DIMENSION = 512


def hashed_features(texts: list[str]) -> np.ndarray:
    """Rows of word counts folded into DIMENSION signed places by a checksum: a deterministic stand-in for an embedding model."""
    out = np.zeros((len(texts), DIMENSION))
    for row, text in zip(out, texts, strict=True):
        for word in _WORD.findall(text.lower()):
            h = zlib.crc32(word.encode())
            row[h % DIMENSION] += 1 if h & 0x80000000 else -1
    return out


def best_span(text: str, topic: np.ndarray, embed: Callable[[list[str]], np.ndarray] = hashed_features, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST, most: int | None = None) -> tuple[int, int, float]:
    """Bytes of the chunk nearest to a topic vector, and its cosine; a text of one chunk is whole. Of equal ones the first; ``most`` chunks at most are compared, all if None."""
    found = chunks_of(text, size, overlap, least)[:most]
    bodies = [c["chunk"] for c in found] or [text]
    v = embed(bodies)
    by = np.linalg.norm(v, axis=1) * np.linalg.norm(topic)
    cosine = np.round(np.divide(v @ topic, by, out=np.zeros(len(v)), where=by > 0), 9)
    best = int(cosine.argmax())
    return (found[best]["start"], found[best]["end"], float(cosine[best])) if found else (0, len(text.encode()), float(cosine[0]))


# ---------------------------------------------------------------- columns


def _text_runs(texts: pa.Array, most: int = 1 << 18, rows: int = 512) -> Iterator[tuple[int, int]]:
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return tx.runs(np.concatenate([[0], np.cumsum(sizes)]), most, rows)


def _each_run(texts: pa.Array, kind: pa.DataType, f: Callable, most: int = 1 << 18, rows: int = 512) -> pa.Array:
    """f of every text, null of null: the texts of some hundred kilobytes, and what is made of them, are Python objects at a time."""
    parts = [pa.array([None if t is None else f(t) for t in texts.slice(a, b - a).to_pylist()], kind) for a, b in _text_runs(texts, most, rows)]
    return pa.concat_arrays([pa.array([], kind), *parts])


def sentence_ranges(text: Column) -> Column:
    """array<struct(start, end)>: bytes of the sentences; null for null."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(texts: pa.Array) -> pa.Array:
        def ranges(t: str) -> list[dict]:
            at = range(len(t) + 1) if t.isascii() else np.concatenate([[0], np.cumsum([len(c.encode()) for c in t])])
            return [{"start": int(at[a]), "end": int(at[b])} for a, b in spans(t)]

        return _each_run(texts, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), ranges)

    return run(text)


def topic(text: Column, most: int = 60) -> Column:
    """First sentence, cut to ``most`` bytes; '' for a text without one, null for null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return _each_run(texts, pa.string(), lambda t: topic_of(t, most))

    return run(text)


CHUNK_FIELDS = {"place": "int", "total": "int", "start": "int", "end": "int", "header": "string", "chunk": "string"}
_CHUNK = pa.struct([(k, pa.int32() if v == "int" else pa.string()) for k, v in CHUNK_FIELDS.items()])


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Chunks of a text, see ``chunks_of``; null for null."""

    @F.arrow_udf(f"array<struct<{','.join(f'{k}:{v}' for k, v in CHUNK_FIELDS.items())}>>")
    def run(texts: pa.Array) -> pa.Array:
        return _each_run(texts, pa.list_(_CHUNK), lambda t: chunks_of(t, size, overlap, least))

    return run(text)


def chunk_batches(batches: Iterator[pa.RecordBatch], size: int, overlap: int, least: int) -> Iterator[pa.RecordBatch]:
    """Batches (id, text) to batches (id and the fields of a chunk), one for each run of some hundred kilobytes of text."""
    for batch in batches:
        ids, texts = batch.columns
        for a, b in _text_runs(texts):
            found = [[] if t is None else chunks_of(t, size, overlap, least) for t in texts.slice(a, b - a).to_pylist()]
            own = np.repeat(np.arange(b - a), [len(x) for x in found])
            if len(own):
                fields = pa.array([c for x in found for c in x], _CHUNK).flatten()
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(own)), *fields], ["id", *CHUNK_FIELDS])


def chunk_rows(rows: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """A row for each chunk of (id, text): its id and the fields of ``chunks_of``. No column of all chunks of many texts is built."""
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(lambda batches: chunk_batches(batches, size, overlap, least), f"id {kind}, " + ", ".join(f"`{k}` {v}" for k, v in CHUNK_FIELDS.items()))


def span(text: Column, topic_text: str, embed: Callable[[list[str]], np.ndarray] = hashed_features, **limits) -> Column:
    """struct(start, end, similarity) of the part of a text nearest to a topic; null for null."""
    kinds = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("similarity", pa.float64())])

    @F.arrow_udf("struct<start:int,end:int,similarity:double>")
    def run(texts: pa.Array) -> pa.Array:
        wanted = embed([topic_text])[0]
        return _each_run(texts, kinds, lambda t: dict(zip(("start", "end", "similarity"), best_span(t, wanted, embed, **limits), strict=True)))

    return run(text)
