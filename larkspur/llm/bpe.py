"""BPE encoding and decoding over a table of distinct words.

1. Texts are split into words in Spark tasks. Each task packs its documents into blocks of up to ``BLOCK_WORDS`` words: the
   words become numbers into the block's own list of distinct words, and that list is cut into parts by word hash.
2. The lists are dealt by part, so that all occurrences of a word meet in one task, which encodes it once: its part of the
   table of distinct words. The ids go back under the numbers that each block gave the word.
3. Blocks meet their words again by block number, and ids are joined back by position.

Nothing is broadcast but the vocabulary; a task holds one block, or the distinct words of one part.
Texts are never shuffled. Decoding joins ids with the vocabulary's pieces, batch by batch.

Words are what the vocabulary's own normalizer and pre-tokenizer make of a text. Texts of U+0000 to U+00FF, for which
normal form C changes nothing, take a regular expression with the same result; all others take the library itself.

Defined results: a null or empty text has no ids and decodes to the empty string. Special tokens written in a text are
special tokens, as the library has it. Repeated rows and repeated or null ids are encoded each. A table without rows gives
no rows. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, new_path, ship, table

BLOCK_WORDS, CHUNK_WORDS = 2_000_000, 100_000
#: Parts of the table of distinct words, at most: each block has a row for each, which shouldn't be too short.
MOST_PARTS = 4096
VOCABULARY = "word_bpe_49k.json"
LETTERS, NUMBERS, SPACES = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r\x20\x85\xa0"
#: The pre-tokenizer's expression for texts of U+0000 to U+00FF.
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: The expression that it stands for; other vocabularies take the library's way for every text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 characters stand for themselves, others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Words:
    """Splits texts into words, and encodes a word, as the tokenizers library does with a vocabulary."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        about = json.loads(source)
        self.tok = Tokenizer.from_str(source)
        added = about["added_tokens"]
        if about["model"]["type"] != "BPE" or about.get("decoder") or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("a BPE vocabulary without decoder and with plain special tokens is needed")
        steps = about["pre_tokenizer"]["pretokenizers"]
        self.latin = steps[0]["pattern"].get("Regex") == PATTERN and [n["type"] for n in about["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.special = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        if "<" not in text or not self.cut.search(text):
            return self._plain(text)
        # Odd places hold special tokens; no plain word looks like one, as words don't mix letters and marks.
        return [w for i, x in enumerate(self.cut.split(text)) for w in ([x] if i % 2 else self._plain(x))]

    def _plain(self, text: str) -> list[str]:
        if self.latin and (text.isascii() or max(text) <= "\xff"):
            return LATIN.findall(text.lower())
        found = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in found]

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.tok.model.tokenize("".join(map(self.letters.__getitem__, word.encode())))]


@lru_cache(maxsize=2)
def _words_of(source: str) -> Words:
    return Words(source)


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


def _pack(values) -> bytes:
    """Whole numbers under 2^32, compressed byte plane by byte plane."""
    import numpy as np
    import zstandard

    planes = np.ascontiguousarray(np.asarray(values, "<u4").view("u1").reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


BLOCKS = "block long, part int, doc_ids array<long>, sizes array<int>, codes binary, words binary"


def _blocks(vocabulary, parts: int, block_words: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        words = _words_of(vocabulary.value)
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = ["block", "part", "doc_ids", "sizes", "codes", "words"]
        block = TaskContext.get().partitionId() << 32
        seen, docs, n = _Codes(), [], 0

        def closed() -> Iterator:
            # The commonest words get the smallest numbers, whose high bytes are all zero.
            flat = np.concatenate([c for _, c in docs])
            rank = np.empty(len(seen), "u4")
            rank[np.argsort(-np.bincount(flat, minlength=len(seen)), kind="stable")] = np.arange(len(seen), dtype="u4")
            rows, chunk, size = [], [], 0
            for i, (doc, codes) in enumerate(docs):
                chunk.append((doc, rank[codes]))
                size += len(codes)
                if size >= CHUNK_WORDS or len(chunk) >= 5000 or i == len(docs) - 1:
                    rows.append((block, -1, [d for d, _ in chunk], [len(c) for _, c in chunk], _pack(np.concatenate([c for _, c in chunk])), None))
                    chunk, size = [], 0
            own: dict[int, list] = {}
            for word, code in seen.items():
                own.setdefault(crc32(word.encode()) % parts, []).append((word, rank[code]))
            # Words hold no line feed: it is white space.
            for part, pairs in own.items():
                rows.append((block, part, None, None, _pack([c for _, c in pairs]), zstandard.ZstdCompressor(level=3).compress("\n".join(w for w, _ in pairs).encode())))
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 64], strict=True), types, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words.split(text.as_py())
                docs.append((doc, np.fromiter(map(seen.__getitem__, found), "u4", len(found))))
                n += len(found)
                if n >= block_words:
                    yield from closed()
                    block += 1
                    seen, docs, n = _Codes(), [], 0
        if docs:
            yield from closed()

    return run


def _encoded(vocabulary):
    """Each word of the parts in this task is encoded once; blocks get the ids under their own numbers."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        words = _words_of(vocabulary.value)
        known: dict[str, list[int]] = {}
        last = None
        for batch in batches:
            out = []
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if part != last:  # rows come by part: a word is in one part only
                    known, last = {}, part
                here = zstandard.ZstdDecompressor().decompress(packed).decode().split("\n")
                ids = []
                for w in here:
                    if (x := known.get(w)) is None:
                        x = known[w] = words.ids(w)
                    ids.append(x)
                out.append((_pack([i for x in ids for i in x]), _pack(np.fromiter(map(len, ids), "u4", len(ids)))))
            ids, sizes = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("codes"), pa.array(ids, pa.binary()), pa.array(sizes, pa.binary())], ["block", "codes", "ids", "id_counts"])

    return run


@lru_cache(maxsize=2)
def _pieces_of(source: str):
    import numpy as np

    tok = _words_of(source).tok
    return np.array([tok.id_to_token(i) for i in range(tok.get_vocab_size(True))], object)


def pieces_of(vocabulary):
    """The piece of each id, by id."""
    return _pieces_of(vocabulary.value)


def joined_pieces(bounds, flat, pieces):
    """The text of each list of ids: an id-to-piece join, then one space between pieces."""
    import pyarrow as pa

    return pa.array([" ".join(pieces[flat[a:b]].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())


def _joined(vocabulary, decoded: bool):
    """One block: ids by number, then ids by position, and, if asked for, pieces by id."""

    def run(docs, words):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), *[("decoded", pa.string())] * decoded])
        if not docs.num_rows:
            return schema.empty_table()
        whole = lambda column: np.concatenate([np.zeros(0, "u4"), *map(_unpack, words.column(column).to_pylist())])
        code, size, flat = whole("codes"), whole("id_counts").astype("i4"), whole("ids").astype("i4")
        first, count = np.zeros(len(code), "i4"), np.zeros(len(code), "i4")
        first[code], count[code] = np.cumsum(size) - size, size
        pieces, out = pieces_of(vocabulary) if decoded else None, []
        for own, lens, packed in zip(docs.column("doc_ids"), docs.column("sizes"), docs.column("codes"), strict=True):
            at = _unpack(packed.as_py())
            n = count[at]
            ends = np.cumsum(n, dtype="i4")
            values = flat[np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype="i4")]
            bounds = np.concatenate([np.zeros(1, "i4"), ends])[np.concatenate([[0], np.cumsum(lens.values.to_numpy())])]
            columns = [own.values, pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))]
            if decoded:
                columns.append(joined_pieces(bounds, values, pieces))
            out.append(pa.table(columns, schema=schema))
        return pa.concat_tables(out)

    return run


def vocabulary_source(path: str | None = None) -> str:
    """The vocabulary file's content, read on the driver: executors get it by broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(
    docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, parts: int | None = None, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, ids) of every row, and on request the text that the ids decode to.

    vocabulary: path of a tokenizers file; parts: into how many the table of distinct words is cut, by default twice the
    shuffle partitions, ``MOST_PARTS`` at most; block_words: larger blocks need more memory, and share more words.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary_source(vocabulary))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # In buckets of blocks: the documents' numbers are not shuffled again.
    path = new_path(spark, "bpe-blocks")
    blocks = bucketed(slim.mapInArrow(_blocks(shared, parts or min(2 * buckets, MOST_PARTS), block_words), BLOCKS), "bpe-blocks", "block", path=path)
    words = spark.read.schema(BLOCKS).parquet(path).where("part >= 0").select("block", "part", "codes", "words").repartition("part").sortWithinPartitions("part")
    ids = words.mapInArrow(_encoded(shared), "block long, codes binary, ids binary, id_counts binary")
    own = blocks.where("part < 0").select("block", "doc_ids", "sizes", "codes")
    return own.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_joined(shared, decoded), "doc_id long, ids array<int>" + ", decoded string" * decoded)


def _decoded(vocabulary):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pieces = pieces_of(vocabulary)
        for batch in batches:
            ids = batch.column("ids")
            texts = joined_pieces(ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False), pieces)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Adds decoded to a table with ids: the ids' pieces, joined by one space. Null ids are not allowed in a list."""
    from pyspark.sql import types as T

    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary_source(vocabulary))
    rest = encoded.drop("decoded").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return rest.mapInArrow(_decoded(shared), T.StructType([*rest.schema.fields, T.StructField("decoded", T.StringType())]))


def encoded_documents(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text). Ids, their number, and digests of ids and decoded texts."""
    out = encode(docs, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("ids")
