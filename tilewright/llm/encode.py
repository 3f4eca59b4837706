"""Token ids of whole texts by a public byte-level tokenizer, and back.

Texts come in Arrow batches.  Byte-level pre-tokenizers never join a
character that is not white space with white space that follows it, so a
text is cut there (over the whole batch, in Arrow), each distinct piece is
encoded once by the ``tokenizers`` library, and the ids are gathered back
into texts.  Pieces already seen by the worker are kept in a dictionary of
bounded size.  Texts that contain the cut mark, and tokenizers with another
pre-tokenizer, are encoded whole.

Decoding reverses the byte-to-character table of byte-level vocabularies, so
a character split over several tokens comes back once all its bytes are
there; bytes that form no character become U+FFFD.

Defined results.  A null, empty text gives an empty list (0 tokens, text "" in
decoding; a null list decodes to null).  Strings that look like special
tokens are ordinary text; no special token is added.  Texts of any length are
encoded whole.  Unknown ids are an error in decoding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary files lie; the environment variable names another folder.
TOKENIZER_DIR = os.environ.get("TILEWRIGHT_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.json"
CACHE_PIECES = 400_000
_MARK = "\x1f"
# fixed values: the characters with the Unicode property White_Space
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CUT = f"([^{_SPACE}])([{_SPACE}])"
_BATCH_CHARS = 4_000_000


@lru_cache(maxsize=4)
def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=4)
def _cuts(path: str) -> bool:
    """Whether the tokenizer's pieces may be cut before white space: it is
    byte-level BPE with its regular pre-tokenizer, no normalizer."""
    import json

    j = json.loads(_load(path).to_str())
    pre = j.get("pre_tokenizer") or {}
    return (
        j.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and bool(pre.get("use_regex"))
        and not pre.get("add_prefix_space")
    )


@lru_cache(maxsize=1)
def _seen(path: str) -> dict[str, np.ndarray]:
    return {}


def encode_array(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, offsets) of an Arrow string array."""
    tokenizer, n = _load(path), len(texts)
    texts = texts.fill_null("")
    if not _cuts(path):
        return _whole(tokenizer, texts.to_pylist())
    odd = pc.match_substring(texts, _MARK).to_numpy(zero_copy_only=False)
    plain = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts) if odd.any() else texts
    pieces = pc.split_pattern(pc.replace_substring_regex(plain, _CUT, rf"\1{_MARK}\2"), _MARK)
    flat = pieces.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    known = _seen(path)
    new = [w for w in words if w not in known]
    if new:
        if len(known) + len(new) > CACHE_PIECES:
            known.clear()
            new = words
        for w, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            known[w] = np.array(e.ids, np.int32)
    ids = [known[w] for w in words]
    length = np.fromiter(map(len, ids), np.int64, len(ids))
    table = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    first = np.cumsum(length) - length
    index = flat.indices.to_numpy()
    each = length[index]
    upto = np.cumsum(each)
    total = int(upto[-1]) if len(upto) else 0
    out = table[np.arange(total) - np.repeat(upto - each, each) + np.repeat(first[index], each)]
    lists = pieces.offsets.to_numpy()
    offsets = np.concatenate([[0], upto])[lists]
    if odd.any():  # put the texts that were encoded whole into their places
        at = np.flatnonzero(odd)
        ids_w, off_w = _whole(tokenizer, texts.take(pa.array(at)).to_pylist())
        size = np.diff(offsets)
        size[at] = np.diff(off_w)
        parts, k = [], 0
        for i in range(n):
            if odd[i]:
                parts.append(ids_w[off_w[k] : off_w[k + 1]])
                k += 1
            else:
                parts.append(out[offsets[i] : offsets[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(size)])
    return out, offsets


def _whole(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((x for i in ids for x in i), np.int32, int(sizes.sum()))
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded text size, at least one row each."""
    sizes = np.cumsum(pc.utf8_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + _BATCH_CHARS, "right")))
        yield batch.slice(start, end - start)
        start = end


def _kept(df: DataFrame, keep: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keep]


def encode(
    df: DataFrame,
    keep: list[str],
    text: str = "text",
    tokenizer: str = BYTE_BPE_50K,
    directory: str | None = None,
    ids: str = "ids",
) -> DataFrame:
    """(keep, ids ARRAY<INT>) of each row's whole text."""
    path = os.path.join(directory or TOKENIZER_DIR, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, len(keep)):
                flat, offsets = encode_array(b.column(len(keep)), path)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*keep, ids])

    out = T.StructType([*_kept(df, keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.select(*keep, text).mapInArrow(run, out)


def count_tokens(
    df: DataFrame,
    keep: list[str],
    text: str = "text",
    tokenizer: str = BYTE_BPE_50K,
    directory: str | None = None,
    count: str = "n_tokens",
) -> DataFrame:
    """(keep, n_tokens LONG) of each row's whole text, the ids themselves left out."""
    path = os.path.join(directory or TOKENIZER_DIR, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, len(keep)):
                _, offsets = encode_array(b.column(len(keep)), path)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(offsets).astype(np.int64))], [*keep, count])

    out = T.StructType([*_kept(df, keep), T.StructField(count, T.LongType())])
    return df.select(*keep, text).mapInArrow(run, out)


def encode_with_offsets(
    df: DataFrame,
    keep: list[str],
    text: str = "text",
    tokenizer: str = BYTE_BPE_50K,
    directory: str | None = None,
) -> DataFrame:
    """(keep, ids, starts, ends): each token with the characters of the text it
    touches, as [start, end); tokens that share one character have equal spans."""
    path = os.path.join(directory or TOKENIZER_DIR, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, len(keep)):
                made = _load(path).encode_batch([t or "" for t in b.column(len(keep)).to_pylist()], add_special_tokens=False)
                cols = [[e.ids for e in made], [[o[0] for o in e.offsets] for e in made], [[o[1] for o in e.offsets] for e in made]]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, pa.list_(pa.int32())) for c in cols]], [*keep, "ids", "starts", "ends"])

    lists = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("ids", "starts", "ends")]
    return df.select(*keep, text).mapInArrow(run, T.StructType([*_kept(df, keep), *lists]))


@lru_cache(maxsize=1)
def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable
    Latin-1 characters for themselves, the other bytes from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    table = {chr(b): b for b in own}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return table


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> list[bytes]:
    table = byte_characters()
    vocabulary = _load(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def decode(
    df: DataFrame,
    keep: list[str],
    ids: str = "ids",
    tokenizer: str = BYTE_BPE_50K,
    directory: str | None = None,
    text: str = "text",
) -> DataFrame:
    """(keep, text) of each row's ids."""
    path = os.path.join(directory or TOKENIZER_DIR, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = _token_bytes(path)
            lists = b.column(len(keep))
            if (pc.min(lists.flatten()).as_py() or 0) < 0:
                raise IndexError("a token id is not negative")
            texts = [None if row is None else b"".join([table[i] for i in row]).decode("utf-8", "replace") for row in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*keep, text])

    return df.select(*keep, ids).mapInArrow(run, T.StructType([*_kept(df, keep), T.StructField(text, T.StringType())]))
