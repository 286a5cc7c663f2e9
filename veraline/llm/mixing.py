"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells source x language x topic are raked until their margins
are the targets; a document is then kept with a probability in proportion to its
cell's factor, so the kept tokens have the target margins in expectation.  Topics are
anchor words: the long words that most documents hold without any being held by more
than a tenth of them; a document's topic is the anchor that it holds most often.
Tokens are those of the vocabulary.  All counts are over all documents.  The cells, one
row per combination of values that occurs, meet on the driver up to FEW_CELLS; more of
them are raked as a table, by sums and joins.  Targets that these cells cannot meet,
or only by emptying some of them, are moved towards the observed margins no further
than it takes; how far the margins then are from the targets is a column of the result.
"""

from __future__ import annotations

import warnings
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veraline.llm.common import encoder, small_batches, tidy, tokenizer_path
from veraline.plans.store import discard, fresh, materialize

DIMENSIONS = ("source", "lang", "topic")
#: Default targets: a margin's token share to this power, normed; 1 leaves the mix as it is.
FLATTEN, NONE = 0.95, "\x00none"
#: Anchor words (of SHORTEST to LONGEST letters and digits, between blanks and marks), and the share of documents that none of them may pass.
TOPICS, COMMON = 32, 0.1
SHORTEST, LONGEST, MARKS = 5, 40, ".,;:!?\"'()[]{}*#|-"
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 200_000
FEW_CELLS = 100_000
#: Raking has met its targets below this error; a cell is emptied if its factor is below this part of what its margins' ratios alone give.
TOLERANCE, EMPTIED = 1e-6, 0.1
#: Rounds of raking a table, and steps of a quarter in which its targets move to the observed margins.
TABLE_ROUNDS, TABLE_STEPS = 60, 4


def anchors(docs: DataFrame) -> list[str]:
    """Up to TOPICS words, those of most documents among the ones that at most COMMON of all documents hold."""
    small_batches(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.update({w for w in map(_bare, set(text.lower().split())) if SHORTEST <= len(w) <= LONGEST and w.isalnum()})
                if len(held) > HELD_WORDS:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    few = counted.where(F.col("n") <= F.lit(COMMON * docs.count())).where("n > 1")
    return [r["word"] for r in few.orderBy(F.desc("n"), "word").limit(TOPICS).collect()]


def _bare(word: str) -> str:
    return word if word.isalnum() else word.strip(MARKS)


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


class TopicFinder:
    """The anchor that a text holds most often as a whole word; ties go to the commoner anchor, which comes first."""

    def __init__(self, words: list[str]):
        self.words, self.machine = words, ahocorasick.Automaton()
        for k, w in enumerate(words):
            self.machine.add_word(w, k)
        if words:
            self.machine.make_automaton()

    def __call__(self, text: str | None) -> str:
        if not text or not self.words:
            return NONE
        lower, counts = text.lower(), [0] * len(self.words)
        for end, k in self.machine.iter(lower):
            start = end + 1 - len(self.words[k])
            if not (start and (lower[start - 1].isalnum() or lower[start - 1] == "_")) and not (end + 1 < len(lower) and (lower[end + 1].isalnum() or lower[end + 1] == "_")):
                counts[k] += 1
        most = max(counts)
        return self.words[counts.index(most)] if most else NONE


def rake(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], tolerance: float = 1e-9, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """(factors, worst margin error): cells * factors has the targets as its margins, if any table on these cells has."""
    factors = np.ones(len(cells))
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, weights=cells * factors, minlength=len(target))
            worst = max(worst, float(np.abs(now - target).max()))
            factors *= np.where(now > 0, target / np.where(now > 0, now, 1), 1)[code]
        if worst < tolerance:
            break
    return factors, worst


def _margins(cells: np.ndarray, codes: list[np.ndarray], like: list[np.ndarray]) -> list[np.ndarray]:
    return [np.bincount(c, weights=cells, minlength=len(x)) / cells.sum() for c, x in zip(codes, like, strict=True)]


def feasible(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], halvings: int = 10) -> tuple[np.ndarray, float]:
    """(factors, part): raked to the targets, moved by the least part found towards the observed margins that empties no cell.

    Cells of a value whose target is 0 get 0, as wanted; a value that occurs in such
    cells only has no target.  With part 1 the other cells keep their shares.
    """
    live = cells > 0
    for code, target in zip(codes, targets, strict=True):
        live &= target[code] > 0
    if not live.any():
        raise ValueError("the target mix gives every combination of source, language and topic nothing")
    share = np.where(live, cells, 0.0)
    share /= share.sum()
    seen = _margins(share, codes, targets)
    goals = [np.where(m > 0, t, 0.0) for m, t in zip(seen, targets, strict=True)]
    goals = [g / g.sum() for g in goals]

    def at(part: float) -> np.ndarray | None:
        moved = [(1 - part) * g + part * m for g, m in zip(goals, seen, strict=True)]
        factors, worst = rake(share, codes, moved)
        plain = np.ones(len(share))
        for code, g, m in zip(codes, moved, seen, strict=True):
            plain *= np.minimum(g / np.where(m > 0, m, 1), 1)[code]
        return factors if worst < TOLERANCE and (factors >= EMPTIED * plain)[live].all() else None

    best, low, high = at(0.0), 0.0, 0.0
    if best is None:
        best, high = np.ones(len(share)), 1.0
        for _ in range(halvings):
            part = (low + high) / 2
            found = at(part)
            best, low, high = (best, part, high) if found is None else (found, low, part)
    return np.where(live | (cells == 0), best, 0.0), high


def with_topic(docs: DataFrame, topic: str, tokens: str, words: list[str], tokenizer: str | None = None) -> DataFrame:
    """docs and two columns: the topic of the text and its number of tokens."""
    small_batches(docs.sparkSession)
    at, path = docs.columns.index("text"), tokenizer or tokenizer_path()

    def run(batches):
        find = TopicFinder(words)
        for batch in batches:
            found = [find(t) for t in batch.column(at).to_pylist()]
            sizes = encoder(path).counts(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(sizes)], names=[*batch.schema.names, topic, tokens])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(topic, T.StringType()), T.StructField(tokens, T.LongType())]))


def default_targets(shares: dict[str, float]) -> dict[str, float]:
    raised = {k: v**FLATTEN for k, v in shares.items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def _free(df: DataFrame, base: str) -> str:
    """base, or with as many underscores as it takes to differ from df's columns, whatever the case of their letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


ADDED = ("topic", "n_tokens", "factor", "probability", "sampled", "raking_error")


def calibrate(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: int = 1, tokenizer: str | None = None) -> DataFrame:
    """docs with ADDED: topic, n_tokens, factor, probability, sampled (boolean), raking_error; with underscores where docs has such a column.

    targets: for each of DIMENSIONS the wanted token share of every value (default:
    default_targets()); a value that isn't named gets none, and shares of values that
    don't occur are dealt to the others with a warning.  Targets that the cells that
    occur cannot meet are relaxed, see feasible(); raking_error is the largest
    difference that is left between a margin and its target.  The largest factor is
    kept with certainty, the others in proportion.  Null values are a value of their
    own.  Texts without tokens weigh nothing; they follow their cell's probability, or
    stay if the cell has no tokens.  The draw is a hash of doc_id and text: equal rows
    share it, and a rerun repeats it.
    """
    names = {c: _free(docs, c) for c in ADDED}
    keys = [fresh(docs, c) for c in DIMENSIONS]
    told = materialize(with_topic(docs, names["topic"], names["n_tokens"], anchors(docs), tokenizer), "topics")
    columns = {"source": "source", "lang": "lang", "topic": names["topic"]}
    keyed = told.withColumns({k: F.coalesce(F.col(columns[d]).cast("string"), F.lit(NONE)) for k, d in zip(keys, DIMENSIONS, strict=True)})
    cells = materialize(keyed.groupBy(*keys).agg(F.sum(names["n_tokens"]).alias("tokens")), "cells")
    rows, table = cells.limit(FEW_CELLS + 1).collect(), None
    own = [fresh(docs, c) for c in ("factor", "probability", "error")]
    if len(rows) <= FEW_CELLS:
        schema = ", ".join(f"`{k}` string" for k in keys) + "".join(f", `{c}` double" for c in own)
        table = F.broadcast(docs.sparkSession.createDataFrame(_factors(rows, targets), schema))  # FEW_CELLS rows at most
    else:
        table = _table_factors(cells.withColumnsRenamed(dict(zip(keys, DIMENSIONS, strict=True))), targets).toDF(*keys, *own)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(2**53)) / F.lit(float(2**53))
    out = keyed.join(table, keys).withColumns({names["factor"]: F.col(own[0]), names["probability"]: F.col(own[1]), names["sampled"]: draw < F.col(own[1]), names["raking_error"]: F.col(own[2])})
    return out.select(*docs.columns, *names.values())


def _goal(dimension: str, margin: dict[str, float], targets: dict[str, dict[str, float]] | None) -> dict[str, float]:
    """The wanted share of each value that has tokens."""
    given = (targets or {}).get(dimension) or default_targets({v: m for v, m in margin.items() if m > 0})
    lost = sorted(v for v, t in given.items() if t > 0 and margin.get(v, 0) <= 0)
    if lost:
        warnings.warn(f"no document has {dimension} {', '.join(map(repr, lost[:5]))}: its share is dealt to the others", stacklevel=2)
    goal = {v: given.get(v, 0.0) * (m > 0) for v, m in margin.items()}
    total = sum(goal.values())
    return {v: g / total for v, g in goal.items()} if total else margin


def _factors(cells: list, targets: dict[str, dict[str, float]] | None) -> list[tuple]:
    """(source, lang, topic, factor, probability, error) of each cell."""
    keys = [tuple(c)[:3] for c in cells]
    tokens = np.array([c["tokens"] or 0 for c in cells], dtype=np.float64)
    total = tokens.sum()
    if not total:
        return [(*k, 1.0, 1.0, 0.0) for k in keys]
    share, codes, wanted = tokens / total, [], []
    for d in range(3):
        values = sorted({k[d] for k in keys})
        at = {v: i for i, v in enumerate(values)}
        code = np.array([at[k[d]] for k in keys])
        margin = np.bincount(code, weights=share, minlength=len(values))
        goal = _goal(DIMENSIONS[d], dict(zip(values, margin.tolist(), strict=True)), targets)
        codes.append(code)
        wanted.append(np.array([goal[v] for v in values]))
    factors, moved = feasible(share, codes, wanted)
    if moved:
        warnings.warn(f"the occurring cells cannot meet the target mix: targets moved by {moved:.4f} of the way to the observed margins", stacklevel=2)
    reached = share * factors
    error = max(float(np.abs(m - w).max()) for m, w in zip(_margins(reached, codes, wanted), wanted, strict=True))
    most = factors[tokens > 0].max()
    kept = np.where(tokens > 0, np.minimum(factors / most, 1.0), 1.0)
    return [(*k, float(f), float(p), error) for k, f, p in zip(keys, factors, kept, strict=True)]


def _table_factors(cells: DataFrame, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """_factors() of a table of cells: each round sums a dimension's margin and joins it back; only errors meet on the driver."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.select(*DIMENSIONS, F.lit(1.0), F.lit(1.0), F.lit(0.0))
    base, goals = cells.withColumn("share", F.coalesce("tokens", F.lit(0)) / F.lit(total)), {}
    for d in DIMENSIONS:
        margin = base.groupBy(d).agg(F.sum("share").alias("seen"))
        given = (targets or {}).get(d)
        if given:
            named = cells.sparkSession.createDataFrame([(v, float(t)) for v, t in given.items()], f"{d} string, wanted double")
            margin = margin.join(named, d, "left").withColumn("wanted", F.coalesce("wanted", F.lit(0.0)) * (F.col("seen") > 0).cast("double"))
        else:
            margin = margin.withColumn("wanted", F.pow("seen", F.lit(FLATTEN)))
        norm = float(margin.agg(F.sum("wanted")).first()[0])
        goals[d] = materialize(margin.withColumn("wanted", F.col("wanted") / norm if norm else F.col("seen")), f"goal-{d}")
    for step in range(TABLE_STEPS + 1):
        part = step / TABLE_STEPS
        current, live = _raked_table(base, goals, part)
        if live:
            break
        warnings.warn(f"the occurring cells cannot meet the target mix: targets moved by {min(part + 1 / TABLE_STEPS, 1):.2f} of the way to the observed margins", stacklevel=2)
    error = max(float(current.groupBy(d).agg(F.sum(F.col("share") * F.col("factor")).alias("now")).join(goals[d], d).agg(F.max(F.abs(F.col("now") - F.col("wanted")))).first()[0]) for d in DIMENSIONS)
    most = float(current.where("share > 0").agg(F.max("factor")).first()[0])
    probability = F.when(F.col("share") > 0, F.least(F.col("factor") / most, F.lit(1.0))).otherwise(1.0)
    return current.select(*DIMENSIONS, "factor", probability, F.lit(error))


def _raked_table(base: DataFrame, goals: dict[str, DataFrame], part: float) -> tuple[DataFrame, bool]:
    """(cells with factor, whether the moved targets are met and no wanted cell is emptied)."""
    wanted: Column = (1 - part) * F.col("wanted") + part * F.col("seen")
    current = base.withColumns({"factor": F.lit(1.0), "plain": F.lit(1.0)})
    held = None
    for r in range(TABLE_ROUNDS):
        errors = []
        for d in DIMENSIONS:
            now = current.groupBy(d).agg(F.sum(F.col("share") * F.col("factor")).alias("now")).join(goals[d], d).select(d, "now", wanted.alias("goal"), (wanted / F.col("seen")).alias("ratio"))
            now = materialize(now, "margin")
            errors.append(float(now.agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0))
            step = F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(1.0)
            moved = {"factor": F.col("factor") * step} | ({"plain": F.col("plain") * F.least(F.coalesce("ratio", F.lit(1.0)), F.lit(1.0))} if not r else {})
            current = materialize(current.join(now, d).withColumns(moved).drop("now", "goal", "ratio"), "raked")
            discard(now, held)
            held = current
        if max(errors) < TOLERANCE:
            emptied = current.where((F.col("share") > 0) & (F.col("plain") > 0) & (F.col("factor") < EMPTIED * F.col("plain"))).limit(1).count()
            return current, not emptied or part >= 1
    return current, part >= 1


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: int = 1) -> DataFrame:
    """The rows of docs that the calibrated probabilities keep."""
    return calibrate(docs, targets, seed).where(F.col(_free(docs, "sampled"))).select(docs.columns)
