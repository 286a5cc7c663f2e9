"""Confirmatory paired statistics: panels, contrasts, registered resampling, decisions.

A panel is long: (item_id, item_index, stratum, arm, seed, correct).  Contrasts are summed
by item; what the draws see are item units.  Each contrast and operation has a random
stream of its own, named by digests, so the streams run as tasks beside each other and
give the same numbers anywhere.  Effects, quantiles and p-values are exact fractions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from fractions import Fraction
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraline.functions import predicates as P
from veraline.functions import versions
from veraline.operators.checks import named, repeated, union, violations
from veraline.operators.trust import canonical_sha256
from veraline.plans.store import materialize

PANEL = "item_id string, item_index long, stratum string, arm string, seed long, correct boolean"
# Arms, contrasts with their alternatives, the generator's batches.
ARMS = ("A0", "A1", "A2", "A3", "A4")
CONTRASTS = (("C1a", "A1", "A0", "greater"), ("C1b", "A2", "A0", "greater"), ("C2", "A3", "A4", "two-sided"))
C1_FAMILY = ("C1a", "C1b")
BOOTSTRAP_BATCH, FLIP_BATCH, MOST_CELLS = 1_024, 4_096, 1_000_000
SCALE = 1_000_000
#: Pieces of a contrast's stream, at least as far as batches and repetitions allow.
PIECES = 64
#: Items of a panel that a task holds.
MOST_ITEMS = 1_000_000


@dataclass(frozen=True)
class Protocol:
    """The registered design."""

    training_seeds: tuple[int, ...] = (101, 202, 303)
    stratum_key: str = "level"
    bootstrap_seed: int = 2026090408
    bootstrap_repetitions: int = 10_000
    randomization_seed: int = 2026090409
    randomization_repetitions: int = 100_000
    confidence_ppm: int = 950_000
    equivalence_confidence_ppm: int = 900_000
    family_alpha_ppm: int = 50_000
    practical_effect_ppm: int = 20_000
    equivalence_margin_ppm: int = 20_000
    rng_algorithm: str = "numpy-pcg64-v1"
    quantile_method: str = "linear-type7-exact"
    randomization_correction: str = "plus-one"
    schema_version: str = versions.STATISTICS_PROTOCOL

    @property
    def sha256(self) -> str:
        return canonical_sha256(asdict(self) | {"training_seeds": list(self.training_seeds)})


def panel_violations(panel: DataFrame, protocol: Protocol) -> DataFrame:
    """Rules on a panel: domains, one cell for each item, arm and seed, one stratum and index an item, indexes from 0 on without gaps."""
    cells = len(ARMS) * len(protocol.training_seeds)
    rules = {"item_id": P.is_identifier(F.col("item_id")), "stratum": F.length("stratum") > 0, "arm": F.col("arm").isin(*ARMS), "seed": F.col("seed").isin(*protocol.training_seeds), "correct": F.col("correct").isNotNull()}
    items = panel.groupBy("item_id").agg(F.count("*").alias("n"), F.countDistinct("arm", "seed").alias("d"), F.min("item_index").alias("i"), F.max("item_index").alias("j"), F.min("stratum") .alias("s"), F.max("stratum").alias("t"))
    whole = {"cells": (F.col("n") == cells) & (F.col("d") == cells), "one_index": F.col("i") == F.col("j"), "one_stratum": F.col("s") == F.col("t")}
    spread = items.agg(F.min("i").alias("least"), F.max("i").alias("most"), F.count("*").alias("n"), F.countDistinct("i").alias("d"))
    gaps = spread.where("n = 0 or least <> 0 or most <> n - 1 or d <> n").select(F.lit("panel").alias("key"))
    return union(violations(panel, "item_id", rules), violations(items, "item_id", whole), repeated(panel, "repeated_cell", "item_id", "arm", "seed"), named(gaps, "consecutive_indexes", "key"))


def differences(panel: DataFrame, treatment: str, control: str) -> DataFrame:
    """(item_id, item_index, stratum, seed, d): treatment less control, of the same item and seed."""
    side = lambda arm, name: panel.where(F.col("arm") == arm).select("item_id", "item_index", "stratum", "seed", F.col("correct").cast("int").alias(name))
    return side(treatment, "t").join(side(control, "c").drop("item_index", "stratum"), ["item_id", "seed"]).select("item_id", "item_index", "stratum", "seed", (F.col("t") - F.col("c")).alias("d"))


def contrast_units(panel: DataFrame) -> DataFrame:
    """(hypothesis, item_index, stratum, u, n): each contrast's item sums over the seeds."""
    parts = [differences(panel, t, c).groupBy("item_index", "stratum").agg(F.sum("d").alias("u"), F.count("*").alias("n")).withColumn("hypothesis", F.lit(h)) for h, t, c, _ in CONTRASTS]
    return union(*parts)


def seed_effects(panel: DataFrame) -> DataFrame:
    """(hypothesis, seed, num, den): each contrast's effect by training seed."""
    return union(*(differences(panel, t, c).groupBy("seed").agg(F.sum("d").alias("num"), F.count("*").alias("den")).select(F.lit(h).alias("hypothesis"), "seed", "num", "den") for h, t, c, _ in CONTRASTS))


def design_sha256(panel: DataFrame, protocol: Protocol, bindings: dict[str, str]) -> str:
    """The digest of what doesn't depend on outcomes: bindings, seeds and items in their order (MOST_ITEMS at most)."""
    items = panel.select("item_id", "item_index", "stratum").distinct().orderBy("item_index").limit(MOST_ITEMS + 1).collect()
    if len(items) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items")
    return canonical_sha256({"schema_version": versions.RESAMPLING_DESIGN, **bindings, "stratum_key": protocol.stratum_key, "training_seeds": list(protocol.training_seeds), "items": [r.asDict() for r in items]})


def stream(protocol: Protocol, base_seed: int, operation: str, hypothesis: str, design: str) -> tuple[str, int]:
    """(digest, 128-bit seed) of the random stream of one operation of one contrast."""
    digest = canonical_sha256({"schema_version": versions.DERIVED_RNG_STREAM, "base_seed": base_seed, "operation": operation, "hypothesis_id": hypothesis, "resampling_design_sha256": design, "statistics_protocol_sha256": protocol.sha256})
    return digest, int(digest[:32], 16)


@dataclass(frozen=True)
class Piece:
    """Some repetitions of one operation: which stratum they draw from (-1: signs of all items), and the generator's state before them."""

    hypothesis: str
    stratum: int
    first: int
    rows: int
    state: str


PIECE = "hypothesis string, stratum int, first long, rows long, state string"


def _draw(rng: np.random.Generator, stratum: int, rows: int, n: int) -> np.ndarray:
    return rng.integers(0, n, size=(rows, n), dtype=np.int64) if stratum >= 0 else rng.integers(0, 2, size=(rows, n), dtype=np.int8)


def _places(strata: np.ndarray) -> list[np.ndarray]:
    """Items of each stratum, strata by name."""
    return [np.flatnonzero(strata == s) for s in sorted(set(strata.tolist()))]


def pieces(hypothesis: str, strata: np.ndarray, repetitions: int, seed: int, signs: bool) -> Iterator[Piece]:
    """The registered stream cut into pieces: batches in their order, in each batch the strata, of each some rows.

    PCG64 draws row after row, so a batch may be cut at any row; signs are drawn four to
    a word, so at each fourth.  Draws are rejected by chance, so a state is known only
    once all before it is drawn: this pass draws and forgets.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    sizes = {-1: len(strata)} if signs else {k: len(at) for k, at in enumerate(_places(strata))}
    batch = min(FLIP_BATCH if signs else BOOTSTRAP_BATCH, max(1, MOST_CELLS // max(sizes.values())))
    step = -(-repetitions // PIECES // 4) * 4 or 4
    for done in range(0, repetitions, batch):
        of_batch = min(batch, repetitions - done)
        for k, n in sizes.items():
            for first in range(0, of_batch, step):
                rows = min(step, of_batch - first)
                yield Piece(hypothesis, k, done + first, rows, json.dumps(rng.bit_generator.state))
                _draw(rng, k, rows, n)


def replayed(piece: Piece, units: np.ndarray, strata: np.ndarray) -> np.ndarray:
    """The totals of a piece's repetitions: of the items drawn from its stratum, or of all items with their signs."""
    bits = np.random.PCG64()
    bits.state = json.loads(piece.state)
    own = units if piece.stratum < 0 else units[_places(strata)[piece.stratum]]
    drawn = _draw(np.random.Generator(bits), piece.stratum, piece.rows, len(own))
    return (drawn.astype(np.int64) * 2 - 1) @ own if piece.stratum < 0 else own[drawn].sum(axis=1)


def type7(ordered: np.ndarray, at: Fraction) -> Fraction:
    """The linear-interpolation quantile of sorted whole numbers, exactly."""
    place = (len(ordered) - 1) * at
    low = place.numerator // place.denominator
    return Fraction(int(ordered[low])) + (place - low) * (int(ordered[min(low + 1, len(ordered) - 1)]) - int(ordered[low]))


def interval(totals: np.ndarray, den: int, confidence_ppm: int) -> tuple[Fraction, Fraction]:
    tail, ordered = Fraction(SCALE - confidence_ppm, 2 * SCALE), np.sort(totals)
    return type7(ordered, tail) / den, type7(ordered, 1 - tail) / den


def half_up_ppm(value: Fraction) -> int:
    """Parts per million, halves away from zero."""
    doubled = abs(value.numerator) * 2 * SCALE + value.denominator
    return (doubled // (2 * value.denominator)) * (-1 if value < 0 else 1)


def holm(p: dict[str, Fraction]) -> dict[str, Fraction]:
    """Step-down adjusted p-values, exactly."""
    out, running = {}, Fraction(0)
    for k, (name, value) in enumerate(sorted(p.items(), key=lambda x: (x[1], x[0]))):
        running = max(running, min(Fraction(1), (len(p) - k) * value))
        out[name] = running
    return out


EVIDENCE = "hypothesis string, point_num long, point_den long, lower string, upper string, eq_lower string, eq_upper string, extreme long, bootstrap_stream string, flip_stream string"


def evidence(panel: DataFrame, protocol: Protocol, bindings: dict[str, str]) -> DataFrame:
    """EVIDENCE of each contrast; fractions as text.

    A task for each contrast and operation writes down the generator's states; pieces of
    the streams are then replayed by as many tasks as there are pieces, PIECES or more a
    contrast.  Item units travel to the tasks: one panel of MOST_ITEMS at most.
    """
    design, spark = design_sha256(panel, protocol, bindings), panel.sparkSession
    alternatives = {h: a for h, _, _, a in CONTRASTS}
    table = contrast_units(panel).orderBy("hypothesis", "item_index").toPandas()  # contrasts x MOST_ITEMS
    items = {h: (t["u"].to_numpy(np.int64), t["stratum"].to_numpy(object)) for h, t in table.groupby("hypothesis")}
    points = {h: (int(t["u"].sum()), int(t["n"].sum())) for h, t in table.groupby("hypothesis")}
    streams = {h: (stream(protocol, protocol.bootstrap_seed, "stratified-item-bootstrap", h, design), stream(protocol, protocol.randomization_seed, "paired-item-sign-flip", h, design)) for h in items}
    held = spark.sparkContext.broadcast(items)

    def states(frames):
        for frame in frames:
            for h, signs in zip(frame["hypothesis"].tolist(), frame["signs"].tolist(), strict=True):
                repetitions = protocol.randomization_repetitions if signs else protocol.bootstrap_repetitions
                found = pieces(h, held.value[h][1], repetitions, streams[h][int(signs)][1], signs)
                while part := [asdict(p) for p in islice(found, 4096)]:
                    yield pd.DataFrame(part)

    def totals(frames):
        for frame in frames:
            for p in (Piece(**r) for r in frame.to_dict("records")):
                units, strata = held.value[p.hypothesis]
                got = replayed(p, units, strata)
                if p.stratum >= 0:
                    yield pd.DataFrame({"hypothesis": p.hypothesis, "rep": np.arange(p.first, p.first + p.rows), "value": got})
                else:
                    seen = int(units.sum())
                    far = got >= seen if alternatives[p.hypothesis] == "greater" else np.abs(got) >= abs(seen)
                    yield pd.DataFrame({"hypothesis": [p.hypothesis], "rep": [-1], "value": [int(far.sum())]})

    asked = spark.createDataFrame([(h, signs) for h in sorted(items) for signs in (False, True)], "hypothesis string, signs boolean")
    made = materialize(asked.repartition(2 * len(items) or 1, "hypothesis", "signs").mapInPandas(states, PIECE), "stream-states")
    dealt = made.repartition(max(1, PIECES * len(items)), "hypothesis", "stratum", "first")
    sums = dealt.mapInPandas(totals, "hypothesis string, rep long, value long").groupBy("hypothesis", "rep").agg(F.sum("value").alias("value"))

    def told(frame: pd.DataFrame) -> pd.DataFrame:
        name = frame["hypothesis"].iloc[0]
        total, den = points[name]
        drawn = frame.loc[frame["rep"] >= 0, "value"].to_numpy(np.int64)
        bounds = [*interval(drawn, den, protocol.confidence_ppm), *interval(drawn, den, protocol.equivalence_confidence_ppm)]
        extreme = int(frame.loc[frame["rep"] < 0, "value"].iloc[0])
        return pd.DataFrame([(name, total, den, *map(str, bounds), extreme, streams[name][0][0], streams[name][1][0])], columns=[x.split()[0] for x in EVIDENCE.split(", ")])

    return sums.groupBy("hypothesis").applyInPandas(told, EVIDENCE)  # a contrast's repetitions and one count


DECISIONS = (
    "hypothesis string, treatment string, control string, point_num long, point_den long, point_ppm long, ci_lower_ppm long, ci_upper_ppm long, extreme_count long, p_num long, p_den long, p_ppm long, holm_ppm long,"
    "unstable boolean, decision string, practical_success boolean"
)


def confirm(panel: DataFrame, protocol: Protocol, bindings: dict[str, str]) -> DataFrame:
    """DECISIONS of the family C1 (Holm-adjusted superiority) and of C2 (superiority, else equivalence within the margin).

    A handful of rows: contrasts are decided on the driver, from the evidence of the tasks.
    """
    told = {r["hypothesis"]: r for r in evidence(panel, protocol, bindings).collect()}
    by_seed: dict[str, list[int]] = {}
    for r in seed_effects(panel).collect():  # contrasts x seeds
        by_seed.setdefault(r["hypothesis"], []).append(r["num"])
    p = {h: Fraction(r["extreme"] + 1, protocol.randomization_repetitions + 1) for h, r in told.items()}
    adjusted = holm({h: p[h] for h in C1_FAMILY})
    alpha, practical, margin = (Fraction(x, SCALE) for x in (protocol.family_alpha_ppm, protocol.practical_effect_ppm, protocol.equivalence_margin_ppm))
    rows = []
    for h, treatment, control, _ in CONTRASTS:
        r = told[h]
        point = Fraction(r["point_num"], r["point_den"])
        low, high, eq_low, eq_high = (Fraction(r[c]) for c in ("lower", "upper", "eq_lower", "eq_upper"))
        success = None
        if h in C1_FAMILY:
            better = adjusted[h] < alpha and low > 0
            decision, success = "superior" if better else "not_superior", better and point >= practical
        elif low > 0 and point >= practical:
            decision = "superior_A3"
        elif high < 0 and point <= -practical:
            decision = "superior_A4"
        else:
            decision = "practical_equivalence" if eq_low > -margin and eq_high < margin else "inconclusive"
        signs = by_seed[h]
        rows.append((h, treatment, control, point.numerator, point.denominator, *map(half_up_ppm, (point, low, high)), r["extreme"], p[h].numerator, p[h].denominator, half_up_ppm(p[h]), half_up_ppm(adjusted[h]) if h in adjusted else None, min(signs) < 0 < max(signs), decision, success))
    return panel.sparkSession.createDataFrame(rows, DECISIONS)


def revalidated(decisions: DataFrame, panel: DataFrame, protocol: Protocol, bindings: dict[str, str]) -> DataFrame:
    """Violations where a recomputation from the panel says otherwise; the draws are deterministic."""
    again = confirm(panel, protocol, bindings)
    other = decisions.exceptAll(again).unionByName(again.exceptAll(decisions)).select("hypothesis").distinct()
    return named(other, "not_reproduced", "hypothesis")


def read_panel(spark, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(panel, bindings) of a panel's JSON document: items with a list of outcomes by seed for each arm."""
    from veraline.sources.documents import read_document

    whole = read_document(spark, path)
    seeds = whole["training_seeds"]
    rows = [(i["item_id"], i["item_index"], i["stratum"], arm, seed, got) for i in whole["items"] for arm, outcomes in sorted(i["correctness"].items()) for seed, got in zip(seeds, outcomes, strict=True)]
    return spark.createDataFrame(rows, PANEL), {k: whole[k] for k in BINDINGS}


# What a panel is bound to.
BINDINGS = (
    "benchmark_descriptor_sha256", "public_items_sha256", "public_item_set_sha256", "sealed_references_sha256", "generation_protocol_sha256", "evaluator_contract_sha256", "evaluator_version_sha256",
)
