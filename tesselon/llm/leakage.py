"""Test passages inside training pages (problem 7): an FM-index per shard of pages, searched for the passages' phrases."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tesselon.functions.keys import distinct_names
from tesselon.llm.fm_index import FMIndex
from tesselon.llm.words import Vocabulary, Words, word_offsets
from tesselon.session import drop_table, store_parts, store_table

#: Words in a row that make a leak; all words of an item that has fewer.
PHRASE = 13
#: Characters of pages in one index, about; a longer page is an index of its own.
SHARD_CHARS = 6_000_000
#: Characters of test material in one block of phrases, about; a longer item is a block of its own.
BLOCK_CHARS = 1_000_000
#: Bytes of blocks sent to the tasks at once; beyond it the stored indexes are read again, but not built again.
BATCH_BYTES = 48_000_000
#: Occurrences located at once.
LOCATE = 1_000_000

_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS = "array<struct<first_word:bigint,last_word:bigint,start:bigint,`end`:bigint>>"


def _pack(parts: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **parts)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data), allow_pickle=False))


class Block:
    """The distinct phrases of some test items over their vocabulary, and the items that have each.

    A phrase is a run of ``words``, which holds the items' words one after the other as numbers of the vocabulary.
    """

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.vocabulary = Vocabulary.of_parts(parts)
        self.words, self.starts, self.lengths, self.first_item, self.items = (parts[c].astype(np.int64) for c in ("words", "starts", "lengths", "first_item", "items"))

    @staticmethod
    def parts_of(texts: list[str], size: int) -> dict[str, np.ndarray]:
        words = Words(texts)
        vocabulary, of_words = Vocabulary.of(words)
        seen: dict[bytes, int] = {}
        starts, lengths, items = [], [], []
        numbers = of_words.astype(np.uint32)
        for k in range(len(texts)):
            i, j = int(words.text_starts[k]), int(words.text_starts[k + 1])
            for at in range(i, max(i + 1, j - size + 1) if j > i else i):
                phrase = numbers[at : min(at + size, j)].tobytes()
                own = seen.setdefault(phrase, len(seen))
                if own == len(starts):
                    starts.append(at)
                    lengths.append(len(phrase) // 4)
                    items.append({k})
                else:
                    items[own].add(k)
        counts = np.fromiter(map(len, items), np.int64, len(items))
        flat = np.array([k for own in items for k in sorted(own)], np.uint32)
        return vocabulary.parts() | {"words": numbers, "starts": np.array(starts, np.uint32), "lengths": np.array(lengths, np.uint32), "first_item": np.append(0, np.cumsum(counts)).astype(np.uint32), "items": flat}


class Shard:
    """Some pages' words as an FM-index over their own vocabulary; it serves any phrases."""

    def __init__(self, vocabulary: Vocabulary, index: FMIndex, begins: np.ndarray) -> None:
        self.vocabulary, self.index, self.begins = vocabulary, index, begins

    @classmethod
    def of(cls, texts: list[str]) -> Shard:
        words = Words(texts)
        vocabulary, of_words = Vocabulary.of(words)
        # an end mark after each text
        n = len(texts)
        symbols = np.zeros(len(of_words) + n, np.int64)
        symbols[np.arange(len(of_words)) + np.repeat(np.arange(n), np.diff(words.text_starts))] = of_words
        return cls(vocabulary, FMIndex.of(symbols, len(vocabulary)), words.text_starts[:-1] + np.arange(n))

    def dump(self) -> bytes:
        return _pack(self.vocabulary.parts() | self.index.parts() | {"begins": self.begins.astype(np.uint32)})

    @classmethod
    def load(cls, data: bytes) -> Shard:
        parts = _unpack(data)
        return cls(Vocabulary.of_parts(parts), FMIndex.of_parts(parts), parts["begins"].astype(np.int64))

    def search(self, block: Block) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """(text, item, merged runs of words) of all occurrences of a block's phrases."""
        own = self.vocabulary.find(block.vocabulary)
        symbols = own[block.words - 1]
        lacking = np.append(0, np.cumsum(symbols == 0))
        whole = np.flatnonzero(lacking[block.starts + block.lengths] == lacking[block.starts])
        if not len(whole):
            return
        starts, lengths = block.starts[whole], block.lengths[whole]
        back = starts[:, None] + lengths[:, None] - 1 - np.arange(int(lengths.max()))
        low, high = self.index.search(symbols[np.maximum(back, 0)], lengths)
        hit = np.flatnonzero(high > low)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        counts = high[hit] - low[hit]
        ends = np.cumsum(counts)
        for start in range(0, int(ends[-1]) if len(ends) else 0, LOCATE):
            at = np.arange(start, min(start + LOCATE, int(ends[-1])))
            which = np.searchsorted(ends, at, side="right")
            places = self.index.locate(low[hit[which]] + at - (ends[which] - counts[which]))
            text = np.searchsorted(self.begins, places, side="right") - 1
            found.append((whole[hit[which]], text, places - self.begins[text]))
        if not found:
            return
        phrase, text, place = (np.concatenate(x) for x in zip(*found, strict=True))
        repeat = block.first_item[phrase + 1] - block.first_item[phrase]
        item = block.items[np.arange(int(repeat.sum())) + np.repeat(block.first_item[phrase] - (np.cumsum(repeat) - repeat), repeat)]
        text, place, size = (np.repeat(x, repeat) for x in (text, place, block.lengths[phrase]))
        order = np.lexsort((item, text))
        text, item, place, size = text[order], item[order], place[order], size[order]
        cuts = np.flatnonzero((text[1:] != text[:-1]) | (item[1:] != item[:-1])) + 1
        for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True):
            yield int(text[i]), int(item[i]), _merge(place[i:j], size[i:j])


def _merge(places: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching runs of words as one."""
    order = np.argsort(places, kind="stable")
    first, last = places[order], np.maximum.accumulate((places + sizes)[order])
    cut = np.flatnonzero(first[1:] > last[:-1]) + 1
    return list(zip(first[np.concatenate(([0], cut))].tolist(), last[np.append(cut, len(last)) - 1].tolist(), strict=True))


def _grouped(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) in groups of about ``chars`` characters; a group ends with the text that reaches them."""
    held: list[tuple[pa.Array, list[str]]] = []
    size = 0
    for batch in batches:
        at, texts = 0, [t or "" for t in batch.column(1).to_pylist()]
        for k, text in enumerate(texts):
            size += len(text)
            if size >= chars:
                held.append((batch.column(0)[at : k + 1], texts[at : k + 1]))
                yield _joined(held)
                held, size, at = [], 0, k + 1
        if at < len(texts):
            held.append((batch.column(0)[at:], texts[at:]))
    if held:
        yield _joined(held)


def _joined(held: list[tuple[pa.Array, list[str]]]) -> tuple[pa.Array, list[str]]:
    return pa.concat_arrays([ids for ids, _ in held]), [t for _, texts in held for t in texts]


def shard_indexes(pages: DataFrame, page_id: str, page_text: str, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``(ids, texts, data)``: a row per shard of about ``shard_chars`` characters of pages, with its FM-index. Pages aren't shuffled."""

    def build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _grouped(batches, shard_chars):
            if any(texts):
                whole = pa.array([0, len(ids)], pa.int32())
                columns = [pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, pa.array(texts, pa.string())), pa.array([Shard.of(texts).dump()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "texts", "data"])

    rows = pages.select(F.col(page_id).alias("p"), F.col(page_text).alias("t"))
    return rows.mapInArrow(build_shards, f"ids array<{pages.schema[page_id].dataType.simpleString()}>, texts array<string>, data binary")


def phrase_blocks(items: DataFrame, item_id: str, item_text: str, phrase: int = PHRASE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(ids, data)``: a row per block of about ``block_chars`` characters of test items, with its distinct phrases."""

    def build_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _grouped(batches, block_chars):
            parts = Block.parts_of(texts, phrase)
            if len(parts["starts"]):
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([_pack(parts)], pa.binary())], ["ids", "data"])

    kind = _item_kind(items, item_id)
    rows = items.select(F.col(item_id).cast(kind).alias("i"), F.col(item_text).alias("t"))
    return rows.mapInArrow(build_blocks, f"ids array<{kind}>, data binary")


def _item_kind(items: DataFrame, item_id: str) -> str:
    return "bigint" if items.schema[item_id].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string"


def _hits(shard: Shard, ids: pa.Array, texts: list[str] | pa.Array, blocks: list[tuple[list, Block]], item_arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
    for names, block in blocks:
        pages, items, spans = [], [], []
        last, offsets = None, None
        for text, item, runs in shard.search(block):
            if text != last:
                last, offsets = text, word_offsets(texts[text] if isinstance(texts, list) else texts[text].as_py())
            pages.append(text)
            items.append(names[item])
            spans.append([{"first_word": a, "last_word": b, "start": int(offsets[0][a]), "end": int(offsets[1][b - 1])} for a, b in runs])
        if pages:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(pages, pa.int64())), pa.array(items, item_arrow), pa.array(spans, _SPANS)], ["p", "i", "spans"])


def _sent(sent: Broadcast) -> list[tuple[list, Block]]:
    return [(names, Block(_unpack(data))) for names, data in sent.value]


def leaks(pages: DataFrame, page_id: str, page_text: str, items: DataFrame, item_id: str, item_text: str, phrase: int = PHRASE, shard_chars: int = SHARD_CHARS, block_chars: int = BLOCK_CHARS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(page_id, item_id, spans)``: every page that holds a passage of a test item, with the passages' places in it.

    A passage is ``phrase`` words in a row of the item, or all its words if it has fewer; words are compared as ``Words``
    says: without case, accents and invisible characters, compatibility forms made plain, entities resolved, tags as a
    space. ``spans`` are the merged runs of matched words: ``first_word`` and ``last_word`` (not included) of the page,
    and ``start`` and ``end`` of the same in characters of the text as stored, ready for removal.

    Null and empty texts hold nothing, and an item without words is never found. Rows with the same id are pages (items)
    of their own, so their pair may come out more than once. Empty tables give no rows. Whole texts are indexed.

    Each shard's index is built once, over its own words, whatever the test material. Tasks make blocks of phrases from
    the test items; batches of blocks of at most ``batch_bytes`` (or a single block) are broadcast and searched for in
    every shard. A single batch is searched for by the task that builds an index. With more the indexes are kept as a
    table, which each batch reads, one after the other, so the driver never holds more than one batch.
    """
    distinct_names(page_id, item_id, "spans")
    spark = pages.sparkSession
    page_type, item_type, kind = pages.schema[page_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString(), _item_kind(items, item_id)
    item_arrow, schema = pa.int64() if kind == "bigint" else pa.string(), f"p {page_type}, i {kind}, spans {SPANS}"
    result = lambda found: found.select(F.col("p").alias(page_id), F.col("i").cast(item_type).alias(item_id), "spans")

    blocks = store_table(phrase_blocks(items, item_id, item_text, phrase, block_chars).withColumn("block", F.monotonically_increasing_id()))
    batches: list[list[int]] = []
    room = 0
    for row in blocks.select("block", F.length("data").alias("size")).orderBy("block").toLocalIterator():
        if not batches or row["size"] > room:
            batches.append([])
            room = batch_bytes
        batches[-1].append(row["block"])
        room -= row["size"]

    def send(batch: list[int]) -> Broadcast:
        rows = blocks.where(F.col("block").between(batch[0], batch[-1])).select("ids", "data").toArrow()
        return spark.sparkContext.broadcast(list(zip(rows["ids"].to_pylist(), rows["data"].to_pylist(), strict=True)))

    if len(batches) <= 1:
        sent = send(batches[0]) if batches else spark.sparkContext.broadcast([])

        def build_and_search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = _sent(sent)
            for ids, texts in _grouped(rows, shard_chars):
                if wanted and any(texts):
                    yield from _hits(Shard.of(texts), ids, texts, wanted, item_arrow)

        return result(pages.select(F.col(page_id).alias("p"), F.col(page_text).alias("t")).mapInArrow(build_and_search, schema))

    shards = store_table(shard_indexes(pages, page_id, page_text, shard_chars))

    def parts() -> Iterator[DataFrame]:
        for batch in batches:
            sent = send(batch)
            yield search_shards(shards, sent, schema, item_arrow)
            sent.destroy()  # its part is written

    found = store_parts(parts())
    drop_table(shards)
    return result(found)


def search_shards(shards: DataFrame, sent: Broadcast, schema: str, item_arrow: pa.DataType) -> DataFrame:
    """``(p, i, spans)``: the occurrences in stored shards of the phrases of the blocks sent."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _sent(sent)
        for batch in batches:
            for k in range(len(batch)):
                yield from _hits(Shard.load(batch.column(2)[k].as_py()), batch.column(0)[k].values, batch.column(1)[k].values, wanted, item_arrow)

    return shards.mapInArrow(search, schema)


def removal_spans(found: DataFrame, page_id: str) -> DataFrame:
    """``(page_id, spans)``: of each page the spans of all items merged, as character offsets (``start``, ``end``) in order."""
    every = found.groupBy(page_id).agg(F.array_sort(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))).alias("s"))
    empty = F.slice("s", 1, 0)

    def add(done: Column, span: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joins = (F.size(done) > 0) & (last["end"] >= span["start"])
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(span)))

    return every.select(page_id, F.aggregate("s", empty, add).alias("spans"))
