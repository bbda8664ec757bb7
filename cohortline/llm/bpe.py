"""Byte-level BPE encoding and decoding by overlapping chunks.

A short text is one chunk. A long text is cut in one pass into chunks that are rows of their own, each reading `overlap` characters into the next. Every chunk is
pre-tokenised from its own start, in parallel, which may be the middle of a pre-token. Two runs of the pattern over the same characters that share one boundary share all
later ones (the pattern never looks back), so neighbours are stitched at the first boundary of the overlap that both have: from there on the later chunk's run is that of the
whole text. Boundaries that the chunk's end may have made (the last characters, white space up to the end) don't count. Each chunk encodes its pre-tokens, those of the
overlaps one by one, so the stitch takes ids from boundary to boundary. Where an overlap has no common boundary, as inside a word of over `overlap` letters, the
text is run on from the last stitch until it meets a chunk's run; only that stretch is encoded in the document's task. A change from a non-space to a space is a
boundary in every run, so a chunk whose overlaps hold one never sends its text along. Decoding concatenates the raw bytes of the ids.

Defined results: a null or empty text has no ids; lone surrogates cannot occur in Spark strings; repeated rows are encoded each; a null doc_id is an id like any
other; a very long text takes time linear in its length, but for a single pre-token; an empty table gives an empty table; columns other than doc_id and text don't matter.
"""

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import pieces, slim

#: Characters of a chunk, and how far it reads into the next one.
CHUNK, OVERLAP = 32_768, 1_024
#: Characters that the pattern looks ahead at most, but for white space.
LOOK = 4
#: A boundary that every run over the text has.
SYNC = regex.compile(r"(?<=\S)(?=\s)")


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoder of a rank file, once a worker."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})


def sync_point(text: str, nominal: int, limit: int) -> int | None:
    """The first boundary at or after `nominal`, before `limit`, that any run over the text has; None if the overlap has none."""
    m = SYNC.search(text, max(nominal, 1), limit)
    return m.start() if m and m.start() < limit else None


def cut(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The text in pieces whose encodings concatenate to that of the whole text."""
    out, at, n = [], 0, len(text)
    nominal = chunk
    while n - at > chunk and nominal < n:
        point = sync_point(text, nominal, min(n, nominal + overlap))
        if point is None:  # no resynchronisation in this overlap: read on into the next chunk
            nominal += overlap
            continue
        out.append(text[at:point])
        at, nominal = point, point + chunk
    out.append(text[at:])
    return out


def encode(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    enc = encoding(path)
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    return [i for piece in cut(text, chunk, overlap) for i in enc.encode_ordinary(piece)]


def decode(ids: list[int], path: str) -> bytes:
    return encoding(path).decode_bytes(ids)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document; long texts are encoded chunk by chunk in parallel.

    `overlap` is at most `chunk`, so no more than two chunks share a character.
    """
    rows = slim(docs, text_col)
    short = rows.where(F.length("text") <= chunk)
    long = rows.where(F.length("text") > chunk)

    def whole(batches):
        for batch in batches:
            for b in pieces(batch):
                ids, n, a, d = b.column(0), [], [], []
                for t in b.column(1).to_pylist():
                    e = encode(t, path)
                    n.append(len(e))
                    a.append(_sha(e))
                    d.append(hashlib.sha256(decode(e, path)).hexdigest())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = short.mapInArrow(whole, schema)

    # a document of many chunks: its id and text key its chunks; rows that repeat both come out as often as they went in
    keyed = long.select("doc_id", F.sha2("text", 256).alias("key"), "text")
    chunks = keyed.mapInArrow(lambda batches: split(batches, chunk, overlap), "doc_id long, key string, k int, last boolean, text string")

    def encode_chunks(batches):
        for batch in batches:
            for b in pieces(batch, 64):
                made = [encode_chunk(t, k, last, path, chunk, overlap) for k, last, t in zip(b.column("k").to_pylist(), b.column("last").to_pylist(), b.column("text").to_pylist())]
                columns = [pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), b.column("k"), *columns], ["doc_id", "key", "k", "raw", "ids", "head", "tail"])

    def whole_text_of(rows):
        rows = rows.sort_values("k", kind="stable")
        times = int((rows["k"] == 0).sum())
        rows = rows.drop_duplicates("k")
        ids = stitch(list(zip(rows["raw"], rows["ids"], rows["head"], rows["tail"])), path, chunk, overlap)
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[[0] * times], "n_tokens": len(ids), "ids_sha256": _sha(ids), "decoded_sha256": hashlib.sha256(decode(ids, path)).hexdigest()})

    parts = spread(chunks).mapInArrow(encode_chunks, "doc_id long, key string, k int, raw string, ids binary, head binary, tail binary")
    return out.unionByName(parts.groupBy("doc_id", "key").applyInPandas(whole_text_of, schema))


def split(batches, chunk: int, overlap: int):
    """Chunk rows of long texts, one pass over each text, a few rows at a time."""
    names, most = ["doc_id", "key", "k", "last", "text"], 64
    for batch in batches:
        for i in range(batch.num_rows):
            one, text = batch.slice(i, 1), batch.column("text")[i].as_py()
            n = -(-len(text) // chunk)
            for a in range(0, n, most):
                ks = range(a, min(n, a + most))
                at = pa.array([0] * len(ks), pa.int32())
                yield pa.RecordBatch.from_arrays([one.column("doc_id").take(at), one.column("key").take(at), pa.array(ks, pa.int32()), pa.array([k == n - 1 for k in ks]),
                                                  pa.array([text[k * chunk:(k + 1) * chunk + overlap] for k in ks], pa.string())], names)


def boundaries(text: str, last: bool) -> list[int]:
    """Boundaries of the pattern's run from the text's start; unless the text ends there, without those that its end may have made."""
    import public_tokenizers

    ends = [0, *(m.end() for m in pattern(public_tokenizers.PATTERN).finditer(text))]
    sure = len(text) if last else min(len(text) - LOOK, len(text.rstrip()))
    return [e for e in ends if e <= sure]


@lru_cache(maxsize=2)
def pattern(p: str):
    return regex.compile(p)


def surely_met(shared: str) -> bool:
    """Every two runs over these characters have a common boundary, which the characters' end does not make."""
    return SYNC.search(shared[:max(0, len(shared) - LOOK + 1)], 1) is not None


def encode_chunk(text: str, k: int, last: bool, path: str, chunk: int, overlap: int) -> tuple[str | None, bytes, bytes, bytes]:
    """The text, if a neighbour may need it; the ids of the chunk's run; (place, number of ids before) of its boundaries in the overlap before and, from its start, after."""
    enc, ends = encoding(path), boundaries(text, last)
    head = [e for e in ends if e < overlap] if k else [0]
    tail = [e for e in ends if e >= chunk] if not last else [len(text)]
    ids, at = [], {head[0]: 0}
    for a, b in zip(head, head[1:]):
        ids += enc.encode_ordinary(text[a:b])
        at[b] = len(ids)
    if tail and tail[0] > head[-1]:
        ids += enc.encode_ordinary(text[head[-1]:tail[0]])
        at[tail[0]] = len(ids)
    for a, b in zip(tail, tail[1:]):
        ids += enc.encode_ordinary(text[a:b])
        at[b] = len(ids)
    alone = (k == 0 or surely_met(text[:overlap])) and (last or surely_met(text[chunk:]))
    places = [np.array([(e - start, at[e]) for e in part], "<i8").tobytes() for part, start in ((head, 0), (tail, chunk))]
    return None if alone else text, np.asarray(ids, "<u4").tobytes(), *places


def stitch(parts: list[tuple[str | None, bytes, bytes, bytes]], path: str, chunk: int, overlap: int) -> list[int]:
    """The ids of the whole text from its chunks, in order."""
    of = lambda x: dict(np.frombuffer(x, "<i8").reshape(-1, 2).tolist())
    out, k, place, first = [], 0, 0, 0
    while k < len(parts) - 1:
        raw, ids, _, tail = parts[k]
        tail, head = of(tail), of(parts[k + 1][2])
        met = next((p for p in tail if p in head), None)
        if met is not None:
            out += np.frombuffer(ids, "<u4")[first:tail[met]].tolist()
            k, place, first = k + 1, met, head[met]
            continue
        # the true run goes on through the next chunks until it meets the run of one; it is looked for after 1, 2, 4, ... chunks, and wherever it must be
        texts, n = [raw[place:chunk]], 0
        while met is None:
            k, n = k + 1, n + 1
            if k == len(parts) - 1:
                return out + encoding(path).encode_ordinary("".join([*texts, parts[k][0]]))
            texts.append(parts[k][0][:chunk])
            if n & (n - 1) == 0 or parts[k + 1][0] is None:
                joined, head = "".join(texts), of(parts[k + 1][2])
                met = next((e - len(joined) for e in boundaries(joined + parts[k][0][chunk:], False) if e - len(joined) in head), None)
        out += encoding(path).encode_ordinary((joined + parts[k][0][chunk:])[:len(joined) + met])
        k, place, first = k + 1, met, head[met]
    return out + np.frombuffer(parts[k][1], "<u4")[first:].tolist()


def spread(chunks: DataFrame) -> DataFrame:
    """Chunks of one document go to many tasks."""
    return chunks.repartition("doc_id", "key", "k")


def _sha(ids: list[int]) -> str:
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
