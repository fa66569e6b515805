"""BPE encoding and decoding through a distinct-word table.

Texts are split at ASCII white space, where the tokenizer never joins across, and every distinct word is
encoded once:

1. Spark counts the words. The commonest, at most ``MAX_TABLE`` of at most ``LONGEST`` bytes each, are encoded
   and broadcast as a table: its size is bounded whatever the input.
2. A document becomes the numbers of its words in that table; the words that it lacks go along in their order.
   Documents are dealt to buckets by their hashes, in one exchange that both of the next steps read.
3. The other words of each bucket, once each, are dealt by word, so that all of a word's buckets meet in one
   partition, which encodes it once and answers them.
4. Buckets meet their answers, and ids are put in the places of the words. The pieces of ids are taken from
   the id-to-piece table, as large as the vocabulary, once for each distinct word.

Partitions are as many as the texts need for ``PART_BYTES`` each, so tasks stay small whatever the input, with
``BUCKETS`` buckets in each. A bucket depends on a document's id and text only, so a lost executor's part
comes out the same again. Numbers travel as bytes, seven bits in each.

Edge cases: a null text is an empty one (no ids); texts of white space have no ids; null ids decode to an
empty text; repeated rows give repeated results; empty tables give empty results; other columns are not
read. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import LARGE_BLOCK_BYTES, SPACES, Words, blocks, checkpointed, list_array, mix, partitions, released, separators, trim

MAX_TABLE, LONGEST = 1 << 18, 48
#: Words that a task meets less often are not counted for the table.
LEAST_MET = 3
#: Bytes of texts in a partition, its buckets, and distinct words that a task counts before it sends them.
PART_BYTES, BUCKETS, MAX_COUNTED = 1 << 24, 3, 1 << 19
#: Words in the answers that a task sends at a time.
ANSWERS = 1 << 16

_PARTS = separators(SPACES)


@lru_cache(2)
def load_tokenizer(definition: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_words(definition: str, words: list[str]) -> list[list[int]]:
    """The ids of each word."""
    return [x.ids for x in load_tokenizer(definition).encode_batch(words, add_special_tokens=False)]


def pieces(definition: str) -> list[str]:
    """The id-to-piece table."""
    names = load_tokenizer(definition).get_vocab(with_added_tokens=True)
    table = [""] * (max(names.values()) + 1)
    for name, number in names.items():
        table[number] = name
    return table


@lru_cache(1)
def _named(definition: str) -> dict[str, str]:
    return {str(k): piece for k, piece in enumerate(pieces(definition))}


def pieces_of(definition: str, ids: list[str]) -> list[str]:
    """Written ids, each with the id-to-piece table's piece in its place."""
    piece = _named(definition).__getitem__
    return [" ".join(map(piece, x.split(" "))) if x else "" for x in ids]


def _decoder(definition: str) -> Callable[[str], str]:
    """The function that makes a text of its pieces, as the tokenizer does."""
    decoder = load_tokenizer(definition).decoder
    return (lambda x: x) if decoder is None else lambda x: decoder.decode(x.split(" ") if x else [])


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, list[bytes], np.ndarray]:
    """The words of a block of texts, the distinct ones, and for each word its place among these."""
    words = Words(data, offsets, _PARTS)
    raw = data.tobytes()
    _, first, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
    length = words.ends - words.starts
    same = np.array_equal(length, length[first][place])
    if same and len(length):  # equal hashes stand for equal words: byte by byte
        inside = np.arange(int(length.sum())) + np.repeat(words.starts - np.cumsum(length) + length, length)
        same = np.array_equal(data[inside], data[inside + np.repeat(words.starts[first][place] - words.starts, length)])
    if not same:
        number: dict[bytes, int] = {}
        whole = [raw[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
        return words, list(dict.fromkeys(whole)), np.array([number.setdefault(w, len(number)) for w in whole], np.int64)
    return words, [raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)], place


def packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows of numbers below 2**28 as bytes; a number's last byte is below 128."""
    values = values.astype(np.uint32)
    size = 1 + (values >= 1 << 7).astype(np.int64) + (values >= 1 << 14) + (values >= 1 << 21)
    ends = np.append(0, np.cumsum(size))
    out = np.empty(int(ends[-1]), np.uint8)
    for k in range(4):
        some = size > k
        out[ends[1:][some] - 1 - k] = (values[some] >> np.uint32(7 * k)) & np.uint32(127) | np.uint32(128 if k else 0)
    bounds = ends[np.append(0, np.cumsum(lengths))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(out.tobytes())])


def unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and where each row's begin, with the end of the last."""
    data = np.frombuffer(b"".join(rows), np.uint8)
    last = np.flatnonzero(data < 128)
    size, values = np.diff(np.append(-1, last)), data[last].astype(np.int64)
    for k in range(1, 4):
        some = size > k
        values[some] |= (data[last[some] - k].astype(np.int64) & 127) << 7 * k
    return values, np.searchsorted(last, np.append(0, np.cumsum(list(map(len, rows)))))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the words that a task meets ``LEAST_MET`` times or more; the empty word stands for the bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        size = 0

        def sent(more: dict[bytes, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(more), pa.binary()).cast(pa.string()), pa.array(list(more.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0), LARGE_BLOCK_BYTES):
                _, distinct, place = distinct_words(data, offsets)
                size += len(data)
                for word, n in zip(distinct, np.bincount(place, minlength=len(distinct)).tolist(), strict=True):
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > MAX_COUNTED:
                    yield sent({w: n for w, n in counts.items() if n >= LEAST_MET and len(w) <= LONGEST})
                    counts.clear()
        yield sent({w: n for w, n in counts.items() if n >= LEAST_MET and len(w) <= LONGEST} | {b"": size})

    return texts.mapInArrow(released(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Table:
    """The commonest words in the order of their counts, with their written ids and the pieces of these."""

    def __init__(self, rows: pa.Table):
        joined = lambda name, mark: pc.binary_join(pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(name).combine_chunks()), mark)[0].as_py()
        self.words, self.ids, self.texts = joined("word", " "), joined("ids", "\n"), joined("texts", "\n")

    def numbers(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words.encode().split(), 1)}


def word_table(texts: DataFrame, definition: str, max_table: int = MAX_TABLE) -> tuple[Table, int]:
    """The table of the commonest words, those with so many counts that at most ``max_table`` have, and the bytes of all texts."""
    counts = checkpointed(word_counts(texts))
    classes = F.floor(F.log2("n") * 16)
    by_size = counts.where("word <> ''").groupBy(classes.alias("size")).agg(F.count("*").alias("words")).collect()  # at most 16 rows for each power of 2
    least, total = 1 << 60, 0
    for size, words in sorted(((r["size"], r.words) for r in by_size), reverse=True):
        total += words
        if total > max_table:
            break
        least = size
    size = counts.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [" ".join(map(str, x)) for x in encode_words(definition, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.string()), pa.array(pieces_of(definition, ids), pa.string())], names=["word", "n", "ids", "texts"])

    # At most max_table short words; the driver only joins what the tasks wrote, so it loads no tokenizer and makes no object for each word.
    rows = counts.where((F.col("word") != "") & (classes >= least)).mapInArrow(released(encoded), "word string, n long, ids string, texts string").toArrow()
    found = Table(rows.sort_by([("n", "descending"), ("word", "ascending")]))
    del rows
    trim()
    return found, size


def _numbered(docs: DataFrame, table, id_column: str, text_column: str, parts: int) -> DataFrame:
    """(bucket, id, numbers, others) of every document: its words' numbers from 1, and 0 for those that ``others`` lists."""
    text = F.coalesce(text_column, F.lit(""))
    source = docs.select(F.pmod(F.xxhash64(id_column, text), F.lit(parts * BUCKETS)).cast("int").alias("bucket"), F.col(id_column).alias("id"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = table.value.numbers()
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(2), LARGE_BLOCK_BYTES):
                words, distinct, place = distinct_words(data, offsets)
                numbers = np.fromiter((number.get(w, 0) for w in distinct), np.int64, len(distinct))[place]
                at = np.flatnonzero(numbers == 0)
                names = [distinct[k].decode() for k in place[at].tolist()]
                cuts = np.searchsorted(words.text[at], np.arange(hi - lo + 1)).tolist()
                others = [" ".join(names[a:b]) if b > a else None for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], packed(numbers, words.counts), pa.array(others, pa.string())], names=["bucket", "id", "numbers", "others"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(released(run), f"bucket int, id {kind}, numbers binary, others string").repartition(parts, "bucket")


def _answers(numbered: DataFrame, definition: str, parts: int) -> DataFrame:
    """(bucket, words, sizes, ids): the ids of all other words of each bucket, each distinct word encoded once."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = pc.split_pattern(batch.column(3), " ")
            bucket = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            names = listed.flatten().dictionary_encode()
            pair = np.unique(bucket.astype(np.int64) << 32 | names.indices.to_numpy(zero_copy_only=False))
            if not len(pair):
                continue
            word = names.dictionary.take(pa.array(pair & 0xFFFFFFFF))
            words, lengths = word.to_pylist(), pc.binary_length(word).to_numpy(zero_copy_only=False)
            whole = Words(np.frombuffer("".join(words).encode(), np.uint8), np.append(0, np.cumsum(lengths, dtype=np.int64)), separators(()))
            part, bucket = (mix(whole.hashes()) % np.uint64(parts)).astype(np.int64), pair >> 32
            order = np.lexsort((bucket, part))
            part, bucket = part[order], bucket[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(first[1:], len(part))
            sorted_words = [words[k] for k in order.tolist()]
            joined = [" ".join(sorted_words[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), packed(bucket, ends - first), pa.array(joined, pa.string())], names=["part", "buckets", "words"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}  # a partition's words: about as many bytes as those of its texts
        own: dict[int, list[str]] = {}
        held = 0

        def sent() -> pa.RecordBatch:
            ids = [known[w] for row in own.values() for w in row]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            lengths = np.fromiter(map(len, own.values()), np.int64, len(own))
            total = np.diff(np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(lengths))])
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([" ".join(x) for x in own.values()], pa.string()), packed(sizes, lengths), packed(flat, total)], names=["bucket", "words", "sizes", "ids"])

        for batch in batches:
            for buckets, joined in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = joined.split(" ")
                for word, bucket in zip(words, unpacked([buckets])[0].tolist(), strict=True):
                    own.setdefault(bucket, []).append(word)
                held += len(words)
                new = list(dict.fromkeys(w for w in words if w not in known))
                known.update(zip(new, encode_words(definition, new), strict=True))
                if held >= ANSWERS:
                    yield sent()
                    own.clear()
                    held = 0
        if own:
            yield sent()

    asked = numbered.mapInArrow(released(ask), "part int, buckets binary, words string").repartition(parts, "part")
    return asked.mapInArrow(released(answer), "bucket int, words string, sizes binary, ids binary").repartition(parts, "bucket")


def _encoded(docs: DataFrame, definition: str, id_column: str, text_column: str, max_table: int, finish: Callable, columns: str) -> DataFrame:
    """(id, *columns) of every document; ``finish`` makes the columns of token counts, written ids and decoded texts."""
    found, size = word_table(docs.select(F.coalesce(text_column, F.lit(""))), definition, max_table)
    table = docs.sparkSession.sparkContext.broadcast(found)  # at most max_table words of bounded length
    parts = max(partitions(docs.sparkSession), -(-size // PART_BYTES))
    numbered = _numbered(docs, table, id_column, text_column, parts)
    names = ["id", *(x.split()[0] for x in columns.split(", "))]
    common: list[list[str]] = []  # a task's buckets share them

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not common:
            common.extend([["", *(x.split("\n") if table.value.words else [])] for x in (table.value.ids, table.value.texts)])
        words: dict[str, int] = {}
        own: list[str] = []
        for joined, sizes, ids in zip(*(right.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            flat, ends = list(map(str, unpacked([ids])[0].tolist())), np.cumsum(unpacked([sizes])[0]).tolist()
            for word, a, b in zip(joined.split(" "), [0, *ends], ends, strict=False):
                words[word] = len(common[0]) + len(own)
                own.append(" ".join(flat[a:b]))
        ids, texts = common[0] + own, common[1] + pieces_of(definition, own)
        tokens = np.fromiter((x.count(" ") + (x != "") for x in ids), np.int64, len(ids))
        out = []
        for batch in left.to_batches(256):
            number, cuts = unpacked(batch.column(2).to_pylist())
            number[number == 0] = [words[w] for x in batch.column(3).to_pylist() if x is not None for w in x.split(" ")]
            rows = [number[a:b].tolist() for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
            joined = lambda parts, rows=rows: [" ".join(filter(None, map(parts.__getitem__, row))) for row in rows]
            counts = np.diff(np.append(0, np.cumsum(tokens[number]))[cuts])
            out.append(pa.RecordBatch.from_arrays([batch.column(1), *finish(counts, joined(ids), joined(texts))], names=names))
        return pa.Table.from_batches(out)

    kind = numbered.schema["id"].dataType.simpleString()
    answers = _answers(numbered, definition, parts)
    rows = numbered.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(meet, f"id {kind}, {columns}")
    return rows.withColumnRenamed("id", id_column)


def _ids(rows: list[str]) -> pa.Array:
    """Written ids of documents as a list column."""
    numbers = [np.fromstring(x, np.int32, sep=" ") for x in rows]
    return list_array(np.concatenate(numbers), np.fromiter(map(len, numbers), np.int64, len(rows)))


def encode(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", max_table: int = MAX_TABLE) -> DataFrame:
    """(id, ids) of every document, as the tokenizer encodes its text without adding special tokens."""
    definition = Path(tokenizer_path).read_text(encoding="utf-8")
    return _encoded(docs, definition, id_column, text_column, max_table, lambda n, ids, texts: [_ids(ids)], "ids array<int>")


def encode_and_decode(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", max_table: int = MAX_TABLE) -> DataFrame:
    """(id, n_tokens, ids, decoded) of every document: its ids and the text that they stand for."""
    definition = Path(tokenizer_path).read_text(encoding="utf-8")

    def finish(n: np.ndarray, ids: list[str], texts: list[str]) -> list[pa.Array]:
        return [pa.array(n, pa.int64()), _ids(ids), pa.array(map(_decoder(definition), texts), pa.string())]

    return _encoded(docs, definition, id_column, text_column, max_table, finish, "n_tokens long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", max_table: int = MAX_TABLE) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every document, encoded and decoded."""
    definition = Path(tokenizer_path).read_text(encoding="utf-8")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def finish(n: np.ndarray, ids: list[str], texts: list[str]) -> list[pa.Array]:
        decoded = _decoder(definition)
        return [pa.array(n, pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array((sha(decoded(x)) for x in texts), pa.string())]

    return _encoded(docs, definition, id_column, text_column, max_table, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(ids: Column, tokenizer_path: str) -> Column:
    """The text that ids stand for, special tokens kept, as the tokenizer decodes it."""
    definition = Path(tokenizer_path).read_text(encoding="utf-8")

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoded = _decoder(definition)
        for batch in batches:
            yield pd.Series(map(decoded, pieces_of(definition, [" ".join(map(str, x)) if x is not None else "" for x in batch])), dtype=object)

    return text(ids)
