"""Best-fit packing by exact-complement hashing.

Pieces of up to ``window`` tokens are packed by their lengths alone, so the plan is made from the histogram of lengths: at
most ``window`` counts, whatever the corpus. The planner keeps hash indexes of what is still available: single lengths, and
the sums of pairs with the number of pairs that give them; triple sums are looked up as a single and a pair. Longest first,
the gap beside a length is filled exactly by a single, a pair or a triple, as often as the counts allow. What has no exact
complement goes best-fit into the open sequence with the least sufficient gap, a whole class of like pieces and like
sequences at a time; every gap that this leaves is tried for an exact complement again. The plan lists patterns (lengths)
with multiplicities; each length's ranks are dealt to the places that patterns have for it. Full windows need no rank; other
pieces get theirs from a count per (length, salt) and a row number within it, with as many salts as the length has use for.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from platewise.llm.common import HOT_SHARE, cut, join_checked, lean, slices, small_batches, table

WINDOW = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"

#: Rows of one length that are ranked in one task, and the most (length, salt) counts that are broadcast.
SALT_ROWS, BROADCAST_SALTS = 500_000, 100_000


class WordEncoder:
    """Token ids of whole texts by a vocabulary of lower-case words with word ends.

    The vocabulary splits text into runs of letters, single digits and runs of marks, and never joins text across white
    space. The runs of a group of texts are found with NumPy, written as symbols (a byte, or a byte that ends its run), made
    distinct by an Arrow dictionary, and only distinct runs are encoded, by a byte-pair merger with the vocabulary's ranks.
    What a character is (small form, white space, letter, digit, mark) is asked of the tokenizer itself, once. Where the
    characters alone do not decide, the tokenizer encodes the whole chunk between white space: contractions, special
    tokens, characters that combine or lie outside the basic plane.
    """

    SPACE, LETTER, DIGIT, MARK, STOP, ODD, UNSEEN = range(7)
    #: Stands between texts; a non-character.
    STOP_CHAR = "￿"
    ODD_PAIRS = r"'[stvmrld]|<\|"
    #: Characters that are encoded at once, and chunks for the tokenizer whose ids are kept.
    GROUP, CACHED = 1 << 20, 100_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = set(self.tokenizer.get_added_tokens_decoder())
        symbols = self._symbols()
        ranks, self.id_of, self.ends = {bytes([b]): b for b in range(256)}, np.zeros(0, np.uint32), np.zeros(0, bool)
        vocabulary = {t: i for t, i in self.tokenizer.get_vocab().items() if i not in special}
        self.size = 1 + max(self.tokenizer.get_vocab().values())
        self.id_of, self.ends = np.zeros(256 + self.size, np.uint32), np.zeros(256 + self.size, bool)
        for token, number in vocabulary.items():
            body = token.removesuffix("</w>")
            last = symbols[body[-1]] + (256 if body != token else 0)
            key = ("".join(chr(symbols[c]) for c in body[:-1]) + chr(last)).encode()
            rank = key[0] if len(key) == 1 else ranks.setdefault(key, 256 + number)
            self.id_of[rank], self.ends[rank] = number, body != token
        self.merger = tiktoken.Encoding("words", pat_str="[^Ā-ǿ]*[Ā-ǿ]", mergeable_ranks=ranks, special_tokens={})
        self.small, self.kind = np.arange(1 << 16, dtype=np.uint16), np.full(1 << 16, self.UNSEEN, np.uint8)
        self.kind[0xD800:0xE000], self.kind[0xFFFF] = self.ODD, self.STOP
        self.kept: dict[str, np.ndarray] = {}

    @staticmethod
    def _symbols() -> dict[str, int]:
        """The byte that each character of a byte-level token stands for."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shifted = [b for b in range(256) if b not in set(plain)]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}

    def _see(self, codes: np.ndarray) -> None:
        """Ask the tokenizer what characters are that were not seen before."""
        for c in np.unique(codes).tolist():
            char = chr(c)
            small = self.tokenizer.normalizer.normalize_str(char)
            jamo = 0x1100 <= c < 0x1200 or 0xA960 <= c < 0xA980 or 0xD7B0 <= c < 0xD800
            if len(small) != 1 or ord(small) > 0xFFFE or jamo or char == "Σ" or any(unicodedata.category(x).startswith("M") for x in char + small):
                self.kind[c] = self.ODD
                continue
            pieces = lambda text: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
            self.small[c] = ord(small)
            self.kind[c] = self.SPACE if not pieces(small) else self.LETTER if pieces(f"a{small}a") == 1 else self.MARK if pieces(f"!{small}!") == 1 else self.DIGIT

    def _runs(self, codes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain characters, and the number of ids of each text (ended by a stop)."""
        ends = np.empty(len(kind), bool)
        ends[:-1], ends[-1] = kind[1:] != kind[:-1], True
        ends |= kind == self.DIGIT
        at = np.flatnonzero(kind & 3)  # neither white space nor a stop
        c, ends = self.small[codes[at]], ends[at]
        # symbols: the bytes of UTF-8, the last of a run raised by 256
        two, three = np.flatnonzero(c >= 0x80), np.flatnonzero(c >= 0x800)
        size = np.ones(len(c), np.int32)
        size[two] += 1
        size[three] += 1
        to = np.cumsum(size, dtype=np.int32) - 1
        last = c.copy()
        last[two] = (c[two] & 0x3F) | 0x80
        last[ends] += 256
        out = np.empty(int(to[-1]) + 1 if len(to) else 0, np.uint16)
        out[to] = last
        out[to[two] - 1] = (c[two] >> 6) | 0xC0
        out[to[three] - 1] = (c[three] >> 6 & 0x3F) | 0x80
        out[to[three] - 2] = (c[three] >> 12) | 0xE0
        data = out.tobytes()
        stops = np.flatnonzero(ends)
        edges = np.concatenate([np.zeros(1, np.int32), ((to[stops] + 1) * 2).astype(np.int32)])
        runs = pa.BinaryArray.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        which = runs.indices.to_numpy()
        distinct = b"".join(runs.dictionary.to_pylist()).decode("utf-16-le")
        found = self.merger.encode_to_numpy(distinct)
        until = np.flatnonzero(self.ends[found]) + 1
        until = until.astype(np.int32)
        start = np.concatenate([np.zeros(1, np.int32), until[:-1]]) if len(until) else until
        count = (until - start)[which]
        upto = np.cumsum(count, dtype=np.int32)
        ids = self.id_of[found][np.repeat(start[which] - upto + count, count) + np.arange(int(upto[-1]) if len(upto) else 0, dtype=np.int32)]
        # text of each run: the number of stops before it
        text_ends = np.flatnonzero(kind == self.STOP)
        runs_before = np.searchsorted(at[stops], text_ends)
        ids_before = np.concatenate([np.zeros(1, np.int64), upto])[runs_before]
        return ids, np.diff(ids_before, prepend=0)

    def _chunks(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of chunks by the tokenizer."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.kept]
        if len(self.kept) + len(new) > self.CACHED:
            self.kept, new = {}, list(dict.fromkeys(chunks))
        for chunk, x in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.kept[chunk] = np.array(x.ids, np.uint32)
        return [self.kept[c] for c in chunks]

    def _plain(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, or None if it has an odd character."""
        codes = np.frombuffer((self.STOP_CHAR.join(texts) + self.STOP_CHAR).encode("utf-16-le", "surrogatepass"), np.uint16)
        kind = self.kind[codes]
        if (kind == self.UNSEEN).any():
            self._see(codes[kind == self.UNSEEN])
            kind = self.kind[codes]
        odd = kind == self.ODD
        for mark, following in (("'", "stvmrld"), ("<", "|")):
            at = np.flatnonzero(codes[:-1] == ord(mark))
            odd[at[np.isin(self.small[codes[at + 1]], [ord(x) for x in following])]] = True
        stops = np.flatnonzero(kind == self.STOP)
        if len(stops) != len(texts):
            return [None] * len(texts)
        hit = set(np.searchsorted(stops, np.flatnonzero(odd)).tolist())
        if hit:
            fine = [t for i, t in enumerate(texts) if i not in hit]
            found = iter(self._plain(fine) if fine else [])
            return [None if i in hit else next(found) for i in range(len(texts))]
        ids, counts = self._runs(codes, kind)
        return np.split(ids, np.cumsum(counts)[:-1])

    def _odd_chunk(self) -> re.Pattern:
        """Chunks between white space with what the characters alone do not decide; unseen characters count as odd."""
        odd = "".join(re.escape(chr(c)) for c in np.flatnonzero(self.kind[:0x3000] >= self.ODD).tolist())
        space = r"[^ \t\n\r\x0b\x0c]*"
        return re.compile(f"({space}(?:[{odd}　-\U0010ffff]|(?i:{self.ODD_PAIRS})){space})")

    def _mixed(self, text: str) -> np.ndarray:
        parts = self._odd_chunk().split(text)
        plain, odd = parts[::2], parts[1::2]
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(parts)
        found[::2] = [x if x is not None else np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint32) for x, p in zip(self._plain(plain), plain, strict=True)]
        found[1::2] = self._chunks(odd)
        return np.concatenate(found)

    def _segments(self, text: str) -> list[str]:
        """Long texts in parts of about GROUP characters, cut at white space."""
        parts, at = [], 0
        while len(text) - at > self.GROUP:
            edge = re.compile(r"[ \t\n\r\x0b\x0c]").search(text, at + self.GROUP)
            if edge is None:
                break
            parts.append(text[at : edge.start()])
            at = edge.start()
        return [*parts, text[at:]]

    def _group(self, group: list[str]) -> list[np.ndarray]:
        return [x if x is not None else self._mixed(t) for x, t in zip(self._plain(group), group, strict=True)]

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        group, size = [], 0
        for text in texts:
            if len(text) > self.GROUP:
                yield from self._group(group) if group else ()
                group, size = [], 0
                yield np.concatenate([self._group([part])[0] for part in self._segments(text)])
                continue
            group.append(text)
            size += len(text)
            if size >= self.GROUP:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)


@cache
def encoder_of(path: str) -> WordEncoder:
    """One encoder per worker process."""
    return WordEncoder(path)


@lean
def _pieces(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, end = encoder_of(path), np.array([end_id], np.uint32)
    narrow = np.dtype("<u2" if max(encoder.size, end_id + 1) <= 1 << 16 else "<u4")
    names = ["ident", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in slices(batches):
        cols: list[list] = [[] for _ in names]
        for ident, ids in zip(batch.column(0).to_pylist(), encoder.encode(t or "" for t in batch.column(1).to_pylist()), strict=True):
            ids = np.concatenate([ids, end]).astype("<u4", copy=False)
            for k, at in enumerate(range(0, len(ids), window)):
                part = ids[at : at + window]
                row = [ident, k, at, len(part), zlib.crc32(part)] + [part.astype(narrow).tobytes()] * with_ids
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names)


def pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token pieces (ident, piece, start, length, ids_crc32[, ids]) of whole texts, cut at ``window`` tokens.

    ``ids`` are little-endian bytes, two or four for each id as the vocabulary needs.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    schema = "ident long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(partial(_pieces, path=path, window=window, end_id=end_id, with_ids=with_ids), schema)


class Sums:
    """Lengths still available, with hash indexes of single, pair and triple sums.

    ``pairs[s]`` is the number of different pairs of available lengths that sum to s; it is kept up as lengths run out, so a
    look-up by complement never meets a pair that is gone.
    """

    def __init__(self, counts: dict[int, int], window: int):
        self.left = np.zeros(window + 1, np.int64)
        for length, n in counts.items():
            self.left[int(length)] = int(n)
        self.there, self.pairs = np.zeros(window + 1, bool), np.zeros(window + 1, np.int64)
        for length in np.flatnonzero(self.left).tolist():
            self.there[length] = True
            self._count(length, 1)
            if self.left[length] > 1 and 2 * length <= window:
                self.pairs[2 * length] += 1

    def _count(self, length: int, by: int) -> None:
        """Count the pairs of a length with the others in or out."""
        others = np.flatnonzero(self.there[: max(0, len(self.there) - length)])
        self.pairs[others[others != length] + length] += by

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x, n in Counter(lengths).items():
            before, self.left[x] = self.left[x], self.left[x] - n * times
            if before > 1 >= self.left[x] and 2 * x < len(self.pairs):
                self.pairs[2 * x] -= 1
            if self.left[x] == 0:
                self.there[x] = False
                self._count(x, -1)

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often a combination is there."""
        return min(int(self.left[x]) // n for x, n in Counter(lengths).items())

    def _pair(self, total: int, held: tuple[int, ...]) -> tuple[int, int] | None:
        if total < 2 or not self.pairs[total]:
            return None
        low = -(-total // 2)
        for x in (low + np.flatnonzero(self.there[low:total] & self.there[total - low : 0 : -1]))[::-1].tolist():
            if self.times((*held, x, total - x)):
                return x, total - x
        return None

    def exact(self, gap: int, held: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """A single, pair or triple that sums to ``gap`` while ``held`` is in use; the longest first length, if several."""
        if gap < 1:
            return None
        if self.there[gap] and self.times((*held, gap)):
            return (gap,)
        if found := self._pair(gap, held):
            return found
        if gap > 2:
            first = np.flatnonzero(self.there[1 : gap - 1] & (self.pairs[gap - 1 : 1 : -1] > 0)) + 1
            for x in first[::-1].tolist():
                if self.times((*held, x)) and (rest := self._pair(gap - x, (*held, x))):
                    return (x, *rest)
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with the number of sequences of each; every piece is in one, none is over ``window``.

    Full windows are not planned: hand in lengths below ``window``, or they are patterns of their own.
    """
    sums = Sums(counts, window)
    done: list[tuple[tuple[int, ...], int]] = []
    if n := int(sums.left[window]):
        sums.take((window,), n)
        done.append(((window,), n))
    for a in np.flatnonzero(sums.there)[::-1].tolist():
        while sums.left[a] and (found := sums.exact(window - a, (a,))):
            pattern = (a, *found)
            n = sums.times(pattern)
            sums.take(pattern, n)
            done.append((pattern, n))

    # best fit for the rest: open sequences are kept by gap as (pattern, number)
    gaps: list[int] = []
    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(gap: int, pattern: tuple[int, ...], n: int) -> None:
        while n and gap and (found := sums.exact(gap)):
            times = min(n, sums.times(found))
            sums.take(found, times)
            done.append((pattern + found, times))
            n -= times
        if not n:
            return
        if gap == 0:
            done.append((pattern, n))
            return
        if gap not in open_at:
            insort(gaps, gap)
            open_at[gap] = []
        open_at[gap].append((pattern, n))

    for length in np.flatnonzero(sums.there)[::-1].tolist():
        n = int(sums.left[length])
        if not n:
            continue
        sums.take((length,), n)
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = window // length
                full, rest = divmod(n, each)
                if full:
                    put(window - each * length, (length,) * each, full)
                if rest:
                    put(window - rest * length, (length,) * rest, 1)
                break
            gap = gaps[at]
            pattern, have = open_at[gap].pop()
            if not open_at[gap]:
                del open_at[gap], gaps[at]
            # all that fit of this length into each sequence of the class
            each = min(gap // length, -(-n // have))
            used = have
            if each * have > n:
                used = n // each
                if used == 0:
                    each, used = n, 1
            n -= each * used
            if have > used:
                put(gap, pattern, have - used)
            put(gap - each * length, pattern + (length,) * each, used)
    done.extend(x for group in open_at.values() for x in group)
    return done


def places(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, from_rank, first_sequence, each, offset) for each run of like pieces in a pattern, by length and rank.

    The piece of rank r is in sequence first_sequence + (r - from_rank) // each, at offset + length * (rank within).
    """
    given: Counter = Counter()
    found, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length, each in Counter(pattern).items():
            found.append((length, given[length], sequence, each, offset))
            given[length] += n * each
            offset += length * each
        sequence += n
    return np.array(sorted(found), np.int64).reshape(-1, 5)


@lean
def _placed(batches: Iterator[pa.RecordBatch], shared, id_bytes: int) -> Iterator[pa.RecordBatch]:
    """Gives each row (its last columns length and rank) its place by binary search among the runs of its length."""
    runs = shared.value
    # ranks are below 2^50, lengths below 2^13
    keys = (runs[:, 0] << 50) + runs[:, 1]
    for batch in slices(batches):
        length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
        mine = runs[np.searchsorted(keys, (length << 50) + rank, side="right") - 1] if len(batch) else np.zeros((0, 5), np.int64)
        within = rank - mine[:, 1]
        kept = batch.drop_columns(["rank"])
        cols = dict(zip(kept.schema.names, kept.columns, strict=True))
        if id_bytes:
            cols["ids"] = _listed(cols["ids"], id_bytes)
        cols |= {"sequence_id": pa.array(mine[:, 2] + within // mine[:, 3]), "offset": pa.array(mine[:, 4] + length * (within % mine[:, 3]))}
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _listed(ids: pa.Array, id_bytes: int) -> pa.Array:
    """Bytes of ids as lists of ints."""
    rows = [np.frombuffer(x, f"<u{id_bytes}") for x in ids.to_pylist()]
    edges = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))


def pack(parts: DataFrame, window: int = WINDOW, id_bytes: int = 0) -> DataFrame:
    """Give each row of ``parts`` (ident, piece, start, length, ids_crc32[, ids]) its sequence_id and offset.

    ``parts`` is read several times: hand in a checkpointed or written table. Only the histogram of lengths (at most
    ``window`` rows) reaches the driver. The plan that goes back follows from it alone: each pattern uses up a length or
    closes a class of like sequences, so it has a small multiple of ``window`` rows. ``id_bytes``: bytes of an id in
    ``ids``, which come back as an array of ints; 0 if there are none.
    """
    spark = parts.sparkSession
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).limit(window + 2).collect()}
    if any(x is None or not 1 <= x <= window for x in counts):
        raise ValueError(f"lengths must be in 1..{window}")
    whole = counts.pop(window, 0)
    runs = places(plan(counts, window))
    names = [c for c in parts.columns]
    given = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    if id_bytes:
        given["ids"] = "array<int>"
    schema = ", ".join(f"{n} {given[n]}" for n in names) + ", sequence_id long, offset long"

    # as many salts as each length has use for; one row per length
    total = sum(counts.values())
    salts = spark.createDataFrame([(int(k), 1 + int(v) // SALT_ROWS + HOT_SHARE * int(v) // total) for k, v in counts.items()], "length long, salts long")
    salted = parts.where(F.col("length") < window).join(F.broadcast(salts), "length")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("ident", "piece"), F.col("salts"))).drop("salts")
    per_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    starts = cut(per_salt.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before")))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("ident", "piece")) - 1)
    ranked = join_checked(ranked, starts, ["length", "salt"], "inner", BROADCAST_SALTS).select(*names, (F.col("rank") + F.col("before")).alias("rank"))
    out = ranked.mapInArrow(partial(_placed, shared=spark.sparkContext.broadcast(runs), id_bytes=id_bytes), schema)
    if whole:
        # a full window is a sequence of its own; rows of a checkpoint keep their order, so the numbers are stable
        full = parts.where(F.col("length") == window).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
        if id_bytes:
            full = full.mapInArrow(partial(_full, id_bytes=id_bytes), schema)
        out = out.unionByName(full)
    return out


@lean
def _full(batches: Iterator[pa.RecordBatch], id_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        cols = [_listed(c, id_bytes) if n == "ids" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
        yield pa.RecordBatch.from_arrays(cols, batch.schema.names)


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: (id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    A document is its token ids and ``end_id``; only longer ones are cut. Null and empty texts are the end id alone.
    Repeated rows are packed once each; among rows alike in identifier and length any may take either place. A null
    identifier stays null. Other columns are not read. An empty table gives an empty result. ``ids``: the token ids, so
    that a sequence is its pieces' ids in order of offset.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with small_batches(docs.sparkSession):
        parts = cut(pieces(docs, path, id_col, text_col, window, end_id, with_ids))
    id_bytes = (2 if max(encoder_of(path).size, end_id + 1) <= 1 << 16 else 4) if with_ids else 0
    return pack(parts, window, id_bytes).withColumnRenamed("ident", id_col)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
