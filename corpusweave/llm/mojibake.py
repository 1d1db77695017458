"""Text that was decoded with the wrong character encoding: finding it and restoring it by expectation-maximization.

Each line with characters beyond ASCII has a latent chain: the encodings it went through (none; UTF-8 read as Windows-1252;
KOI8-R read as Windows-1251; UTF-8 read wrongly twice; ...). Undoing a chain gives what the line would have been; its likelihood is that
of a character model of the corpus itself. Neither the model nor how often each chain occurs is known, so both are estimated from
all lines together, by rounds: the posterior of each line's chains under what is known so far, then the model and the
chains' frequencies anew from these posteriors. Frequencies are by source (repositories, in SOURCES hashed groups) and drawn
towards those of the whole corpus, so weak evidence in one record is helped by its neighbours. At the end each line is repaired by
its likeliest chain.

All lines of all records count; equal lines of a source are one line with a count. The model (hashed character pairs)
and the frequencies have a fixed size, whatever the corpus; only they are gathered and sent to tasks.
A replacement character stands for text that is lost: such lines are garbled and can't be restored.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.lookalike import skeleton
from corpusweave.runtime import spread, written

#: Groups of sources that have chain frequencies of their own.
SOURCES = 1024
#: log2 of the model's counters for pairs of characters.
PAIRS = 18
#: Counters of the model in a range that is summed up by itself.
RANGE = 1 << 14
#: Rounds of expectation and maximization.
ROUNDS = 3
#: Share of a chain to begin with, all but the null chain together, and how many lines of the whole corpus's shares a source is worth.
FIRST, WORTH = 0.01, 20.0
# Encodings text may have been in, and those it may have been read in.
SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "cp437", "cp850", "cp866", "mac-roman", "iso8859-2", "iso8859-5", "cp1253", "iso8859-15")
DOUBLE = ("cp932", "gb18030", "euc-jp", "big5", "euc-kr")
RIGHT = ("utf-8", *SINGLE, *DOUBLE)
WRONG = (*SINGLE, *DOUBLE)
#: Chains by number; 0 is none, 1 is lost text.
CHAINS: tuple[tuple[str, ...], ...] = (
    (), ("lost",), *((w, r) for w in WRONG for r in RIGHT if w != r and {w, r} != {"cp1252", "latin-1"} and not (w in DOUBLE and r != "utf-8")),
    *((w, "utf-8", w, "utf-8") for w in SINGLE), ("latin-1", "utf-8", "cp1252", "utf-8"), ("cp1252", "utf-8", "latin-1", "utf-8"),
)
NUMBER = {c: i for i, c in enumerate(CHAINS)}
_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]")


@functools.lru_cache(maxsize=1)
def _loose() -> dict[str, set[int]]:
    """Characters that stand for bytes a Windows code page leaves undefined: such bytes are commonly read as C1 controls."""
    tables = {}
    for name in ("cp1252", "cp1250", "cp1251", "cp1253"):
        tables[name] = set()
        for b in range(0x80, 0xA0):
            try:
                bytes([b]).decode(name)
            except UnicodeDecodeError:
                tables[name].add(b)
    return tables


def _encode(text: str, name: str) -> bytes | None:
    try:
        return text.encode(name)
    except UnicodeEncodeError:
        pass
    undefined = _loose().get(name)
    if undefined and any(ord(c) in undefined for c in set(text)):
        try:
            return b"".join([bytes([ord(c)]) if ord(c) in undefined else c.encode(name) for c in text])
        except UnicodeEncodeError:
            pass
    return None


def _undo(text: str, chain: tuple[str, ...]) -> str | None:
    for wrong, right in zip(chain[::2], chain[1::2]):
        raw = _encode(text, wrong)
        if raw is None:
            return None
        try:
            text = raw.decode(right)
        except UnicodeDecodeError:
            return None
    return text


def _restored(text: str) -> list[tuple[int, str]]:
    """(chain, text) of every chain that can be undone and changes the text; equal results only once."""
    out, seen = [], {text}
    raws: dict[str, bytes | None] = {}
    for i, chain in enumerate(CHAINS[2:], 2):
        wrong = chain[0]
        if wrong not in raws:
            raws[wrong] = _encode(text, wrong)
        if raws[wrong] is None:
            continue
        try:
            got = raws[wrong].decode(chain[1])
        except UnicodeDecodeError:
            continue
        if len(chain) > 2:
            got = _undo(got, chain[2:])
        if got is not None and got not in seen and not _CONTROL.search(got) and "�" not in got:
            seen.add(got)
            out.append((i, got))
    return out


def _ascii(text: str) -> str:
    return re.sub(r"[^\x00-\x7f]", "", text)


def plain(line: str) -> str:
    """The line with words that merely hold look-alike or invisible characters in ASCII: they are no evidence."""
    words = line.split(" ")
    return " ".join([w if w.isascii() or not (s := skeleton(w, more=False)).isascii() else s for w in words])


def candidates(line: str) -> list[tuple[int, str, str]]:
    """(chain, text to score, restored line), the null chain first. Where no chain fits the whole line, chains are undone word by word.

    Look-alikes are no evidence: the null chain is also scored with them in ASCII, and so are words that a chain leaves as they
    are. But chains are undone on the line itself, as a letter of garbled text may look like another by chance.
    """
    if "�" in line:
        return [(1, line, line)]
    null = [(0, x, line) for x in dict.fromkeys([plain(line), line])]
    out = [(c, x, x) for c, x in _restored(line)]
    if " " in line:
        have = {c for c, _, _ in out}
        words = line.split(" ")
        folded = [plain(w) for w in words]
        parts = {w: dict(_restored(w)) for w in set(words) if not w.isascii()}
        for c in set().union(*parts.values()) - have if len(parts) > 1 or not out else ():
            out.append((c, *(" ".join([parts[w].get(c, x) if w in parts else w for w, x in zip(words, rest)]) for rest in (folded, words))))
    if null[0][1].isascii():  # look-alikes alone: a chain that makes letters of ASCII ones has no evidence but a shorter text
        out = [x for x in out if _ascii(x[2]) == _ascii(line)]
    return null + out


class Model:
    """Character pairs with back-off to characters; counters of a fixed size."""

    def __init__(self, pairs: np.ndarray | None = None, chars: np.ndarray | None = None):
        self.pairs = np.zeros(1 << PAIRS) if pairs is None else pairs
        self.chars = np.zeros(1 << 16) if chars is None else chars

    @staticmethod
    def codes(text: str) -> tuple[np.ndarray, np.ndarray]:
        c = np.frombuffer(("\n" + text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        pair = (c[:-1] * np.uint64(0x9E3779B97F4A7C55) + c[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - PAIRS)
        return c & np.uint64(0xFFFF), pair

    def add(self, text: str, weight: float) -> None:
        c, pair = self.codes(text)
        np.add.at(self.pairs, pair, weight)
        np.add.at(self.chars, c[1:], weight)

    def ready(self) -> Model:
        total = self.chars.sum()
        self.alone = (self.chars + 0.02) / (total + 0.02 * 65536)
        return self

    def score(self, text: str) -> float:
        c, pair = self.codes(text)
        before = self.chars[c[:-1]]
        before[0] = self.chars[10]
        return float(np.log((self.pairs[pair] + 2 * self.alone[c[1:]]) / (before + 2)).sum())


class Scored:
    """A line's candidates and their likelihoods: what is the same for every source."""

    def __init__(self, chains: list[int], texts: list[str], model: Model):
        self.chains = np.array(chains)
        self.logs = np.array([model.score(t) for t in texts]) if len(texts) > 1 else np.zeros(1)

    def posterior(self, log_prior: np.ndarray) -> np.ndarray:
        logs = self.logs + log_prior[self.chains]
        p = np.exp(logs - logs.max())
        return p / p.sum()


def _source(key: int | None) -> int:
    return 0 if key is None else (key * 0x9E3779B97F4A7C55 & (1 << 64) - 1) >> 54


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, str], int] = {}

    def out():
        rows = [(s, x, n) for (s, x), n in counts.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["source", "line", "n"])

    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text.isascii():
                continue
            s = _source(key)
            for x in text.split("\n"):
                if not x.isascii():
                    k = s, x.strip()
                    counts[k] = counts.get(k, 0) + 1
        if len(counts) > 100_000:
            yield out()
            counts.clear()
    yield out()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of each distinct line, once for all rounds."""
    for b in batches:
        found = [candidates(x) for x in b.column(0).to_pylist()]
        chains, texts = ([[c[k] for c in x] for x in found] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(chains, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string())), *b.columns[1:]], names=["chains", "texts", "sources", "counts"])


def _blob(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype(np.float32).tobytes(), 1)


def _array(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), np.float32).astype(np.float64)


def _expect(state):
    """One round over a task's lines: what they add to the model and to the frequencies. Frequencies are kept as logarithms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, counts = Model(), np.zeros((SOURCES, len(CHAINS)))
        model, priors = _unpacked(state.value) if state else (None, None)
        for b in batches:
            for chains, texts, sources, ns in zip(*(c.to_pylist() for c in b.columns)):
                if model is None:
                    counts[sources, 0] += ns
                    new.add(texts[0], sum(ns))
                    continue
                line, weights = Scored(chains, texts, model), np.zeros(len(chains))
                for s, n in zip(sources, ns):
                    p = n * line.posterior(priors[s])
                    np.add.at(counts[s], line.chains, p)  # the null chain may be there twice
                    weights += p
                for text, w, c in zip(texts, weights, chains):
                    if w > 1e-4 and c != 1:
                        new.add(text, w)
        # by ranges, so that the sum of many tasks is spread over as many reducers
        whole = np.concatenate([new.pairs, new.chars, counts.ravel()])
        ranges = [(k, whole[k * RANGE : (k + 1) * RANGE]) for k in range(-(-len(whole) // RANGE))]
        ranges = [(k, _blob(x)) for k, x in ranges if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in ranges], pa.int32()), pa.array([x for _, x in ranges], pa.binary())], names=["part", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[k] = sums.get(k, 0) + _array(x)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_blob(x) for x in sums.values()], pa.binary())], names=["part", "sums"])


def _unpacked(state: tuple[bytes, bytes, bytes, bool]) -> tuple[Model, np.ndarray]:
    pairs, chars, counts, first = state
    model = Model(_array(pairs), _array(chars)).ready()
    n = len(CHAINS)
    begin = np.full(n, FIRST / (n - 1))
    begin[0] = 1 - FIRST
    if first:
        return model, np.tile(np.log(begin), (SOURCES, 1))
    counts = _array(counts).reshape(SOURCES, n)
    every = counts.sum(0) + 10 * begin
    every /= every.sum()
    mine = counts + WORTH * every
    return model, np.log(mine / mine.sum(1, keepdims=True))


def fit(texts: DataFrame, source: str, text: str, rounds: int = ROUNDS) -> tuple[bytes, bytes, bytes, bool]:
    """The model and the chain frequencies of all lines; a few MB, whatever the corpus."""
    sc = texts.sparkSession.sparkContext
    kind = "source int, line string, n long"
    counted = spread(texts.select(F.col(source).cast("long"), text).where(F.col(text).rlike("[^\\x00-\\x7F]"))).mapInArrow(_lines, kind)
    # one shuffle for both sums; of a fixed number of partitions, as few bytes of lines make much work
    counted = counted.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "line")
    by_line = counted.groupBy("source", "line").agg(F.sum("n").alias("n")).groupBy("line").agg(F.collect_list(F.struct("source", "n")).alias("at"))  # at most SOURCES in a list
    lines = by_line.select("line", F.col("at.source").alias("sources"), F.col("at.n").alias("counts"))
    lines = written(lines.mapInArrow(_candidates, "chains array<int>, texts array<string>, sources array<int>, counts array<long>"), "moji-lines")
    state = None
    for k in range(rounds + 1):
        shared = sc.broadcast(state) if state else None
        parts = spread(lines).mapInArrow(_expect(shared), "part int, sums binary").repartition("part").mapInArrow(_add, "part int, sums binary")
        sizes = (1 << PAIRS, 1 << 16, SOURCES * len(CHAINS))
        whole = np.zeros(sum(sizes))
        for part, sums in parts.collect():  # a row for each RANGE of the model
            got = _array(bytes(sums))
            whole[part * RANGE : part * RANGE + len(got)] = got
        ends = np.cumsum(sizes)
        state = (*(_blob(x) for x in np.split(whole, ends[:-1])), k == 0)
    return state


def repair(df: DataFrame, key: str, source: str, text: str, rounds: int = ROUNDS) -> DataFrame:
    """(key, garbled_lines array<int>, chains array<string>, restored string) of each row with garbled text.

    restored is the whole text with each garbled line restored; null if a line's text is lost. Null and empty texts, and
    those in ASCII, give no row. A null source is a source like any other.
    """
    state = fit(df, source, text, rounds)
    shared = df.sparkSession.sparkContext.broadcast(state)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, priors = _unpacked(shared.value)
        scored: dict[str, tuple[Scored, list[str]]] = {}
        known: dict[tuple[int, str], tuple[int, str]] = {}
        for b in batches:
            rows = []
            for k, s, t in zip(*(c.to_pylist() for c in b.columns)):
                if t.isascii():
                    continue
                lines, numbers, chains, lost = t.split("\n"), [], [], False
                g = _source(s)
                for i, x in enumerate(lines):
                    if x.isascii():
                        continue
                    body = x.strip()
                    best = known.get((g, body))
                    if best is None:
                        if body not in scored:
                            if len(scored) > 50_000:
                                scored.clear()
                            of, texts, restored = map(list, zip(*candidates(body)))
                            scored[body] = Scored(of, texts, model), restored
                        line, restored = scored[body]
                        j = int(np.argmax(line.logs + priors[g][line.chains]))
                        best = (int(line.chains[j]), restored[j])
                        if len(known) > 200_000:
                            known.clear()
                        known[g, body] = best
                    if best[0]:
                        numbers.append(i + 1), chains.append(" < ".join(CHAINS[best[0]]))
                        lost |= best[0] == 1
                        lines[i] = x.replace(body, best[1])
                if numbers:
                    rows.append((k, numbers, chains, None if lost else "\n".join(lines)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.string())],
                names=[key, "garbled_lines", "chains", "restored"],
            )

    rows = spread(df.select(key, F.col(source).cast("long"), text).where(F.col(text).rlike("[^\\x00-\\x7F]")))
    return rows.mapInArrow(run, f"{key} {kind}, garbled_lines array<int>, chains array<string>, restored string")
