"""Genetic search for the best or worst starting set. A population is one long table, evaluated in one job.

genes: (individual_id, gene_pos, row_id). All draws come from hashes of seed, generation and individual, so a run repeats
exactly on any partitioning.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw, draw_int, draw_unit
from ..functions.text import normal_label, words
from ..operators import evaluate
from ..operators.models import get_model
from ..operators.prepare import drop_null, rare_grouped
from ..operators.vectorizer import BROADCAST_BYTES, class_counted, counted, row_ends, seams
from ..session import cut, few, large, written
from ..sources.tables import append_csv


def dataset(df: DataFrame, text: str, label: str, row_id: str, least: int | None, labels: DataFrame | None = None) -> DataFrame:
    """(row_id, text, label): cleaned as for a run, and only labels that the run knows."""
    clean = drop_null(df, text, label).select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), normal_label(F.col(label)).alias("label"))
    rows = rare_grouped(clean, "label", least)
    return rows if labels is None else rows.join(few(labels.select("label")), "label", "left_semi").select("row_id", "text", "label")


def init_population(rows: DataFrame, size: int, population: int, seed=42) -> DataFrame:
    """Independent draws of `size` different rows; each partition passes on only each individual's first rows."""
    each = rows.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(population - 1))).alias("individual_id"))
    w = Window.partitionBy("individual_id").orderBy(draw(seed, F.col("individual_id"), F.col("row_id")), "row_id")
    return each.withColumn("n", F.row_number().over(w)).where(F.col("n") <= size).select("individual_id", (F.col("n") - 1).alias("gene_pos"), "row_id")


def class_terms(genes: DataFrame, rows: DataFrame, low: int, high: int) -> DataFrame:
    """(individual_id, label, term): terms of the class documents of every individual's rows, with binary weights."""
    chosen = few(genes.select("individual_id", "row_id")).join(large(rows), "row_id")
    return class_counted(chosen, low, high, ("individual_id", "label")).select("individual_id", "label", "term")


def fitness(genes: DataFrame, rows: DataFrame, query_terms: DataFrame, low: int = 1, high: int = 2, labels: DataFrame | None = None) -> DataFrame:
    """(individual_id, accuracy, macro_f1) of models of each individual's rows on all rows.

    query_terms: (row_id, term), made once a run. The join is on the term, so its size is the pairs that share one.
    """
    a = cut(class_terms(genes, rows, low, high))
    scores = large(query_terms).join(sized(a), "term").groupBy("individual_id", "row_id", "label").agg(F.count("*").alias("score"))
    return judged(scores, a.groupBy("individual_id").agg(F.min("label").alias("fallback")), rows, labels)


def sized(terms: DataFrame) -> DataFrame:
    """A written table with a column term, to be broadcast if its measured size allows."""
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    return F.broadcast(terms) if size <= BROADCAST_BYTES else terms


def judged(scores: DataFrame, first: DataFrame, rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(individual_id, accuracy, macro_f1) from scores (individual_id, row_id, label, score), where they are not 0.

    first: (individual_id, fallback), the label of rows that share no term with any class.
    """
    best = scores.groupBy("individual_id", "row_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("label").alias("predicted"))).alias("b")).select("individual_id", "row_id", "b.predicted")
    hits = best.join(large(rows.select("row_id", "label")), "row_id").groupBy("individual_id", "label", "predicted").agg(F.count("*").alias("n"))
    hits = cut(hits)  # individuals x classes x classes, used twice
    found = hits.groupBy("individual_id", "label").agg(F.sum("n").alias("n"))
    support = rows.groupBy("label").agg(F.count("*").alias("total"))
    every = first.crossJoin(F.broadcast(support))  # individuals x classes
    missed = every.join(found, ["individual_id", "label"], "left").select("individual_id", "label", F.col("fallback").alias("predicted"), (F.col("total") - F.coalesce("n", F.lit(0))).alias("n"))
    confusion = hits.unionByName(missed)
    pairs = confusion.select("individual_id", F.explode(F.array(F.struct(F.col("label").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("t")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("t")))).alias("x")).select("individual_id", "x.*")
    each = pairs.groupBy("individual_id", "label").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    if labels is not None:
        each = first.select("individual_id").crossJoin(F.broadcast(labels.select("label"))).join(each, ["individual_id", "label"], "left").na.fill(0)
    f1 = F.when(F.col("s") + F.col("p") > 0, 2.0 * F.col("t") / (F.col("s") + F.col("p"))).otherwise(0.0)
    return each.groupBy("individual_id").agg((F.sum("t") / F.sum("s")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


class Lineage:
    """Term profiles and scores of a population, each member's derived from its parent's.

    A member's class-term counts are its parent's, plus those of the rows it gained, less those of the rows it lost; n-grams
    across texts are counted from the texts' first and last words. Terms whose count reaches or leaves zero are what changed
    in its profile, and only they meet the rows' terms to move the parent's scores. Texts are read once a run. `changed` is the
    number of (member, label, term) that the last generation took up; a member without a parent takes up all of its terms.
    """

    def __init__(self, rows: DataFrame, low: int, high: int):
        """rows: (row_id, text, label)."""
        self.low, self.high, back = low, high, max(high - 1, 1)
        self.labels = rows.select("row_id", "label")
        self.inner = cut(counted(rows, low, high))
        self.ends = row_ends(rows, back, ("label",))
        spark, kinds = rows.sparkSession, {f.name: f.dataType.simpleString() for f in rows.schema}
        none = lambda schema: spark.createDataFrame([], schema)
        self.genes = none(f"individual_id int, row_id {kinds['row_id']}")
        self.counts = none(f"individual_id int, label {kinds['label']}, term string, tf long")
        self.seams = none(f"individual_id int, label {kinds['label']}, term string, tf long")
        self.scores = none(f"individual_id int, row_id {kinds['row_id']}, label {kinds['label']}, score long")
        self.changed = 0

    def move(self, genes: DataFrame, parents: dict[int, int]) -> None:
        """From now on the members are those of genes; parents: of each member that has one, its parent in the last generation."""
        spark, by = genes.sparkSession, ["individual_id", "label", "term"]
        genes = genes.select("individual_id", "row_id")
        origin = F.broadcast(spark.createDataFrame([(i, p) for i, p in parents.items()], "individual_id int, parent int"))  # a row a member
        inherited = lambda df: df.withColumnRenamed("individual_id", "parent").join(origin, "parent").drop("parent")
        before = inherited(self.genes)
        gained, lost = genes.join(before, ["individual_id", "row_id"], "left_anti"), before.join(genes, ["individual_id", "row_id"], "left_anti")
        swapped = gained.withColumn("sign", F.lit(1)).unionByName(lost.withColumn("sign", F.lit(-1)))
        swapped = few(few(swapped).join(large(self.labels), "row_id"))
        moved = swapped.join(large(self.inner), "row_id").select(*by, (F.col("tf") * F.col("sign")).alias("tf"))
        across = self.seams.limit(0)
        if self.high > 1:
            joined = few(genes).join(large(self.ends), "row_id").select("individual_id", "label", "row_id", "t")
            across = cut(seams(joined, self.low, self.high, ("individual_id", "label")).groupBy(*by).agg(F.count("*").alias("tf")))
        moved = moved.unionByName(across).unionByName(inherited(self.seams).withColumn("tf", -F.col("tf")))
        moved = moved.groupBy(*by).agg(F.sum("tf").alias("d")).where("d <> 0")
        had = F.coalesce("tf", F.lit(0).cast("long"))
        both = cut(inherited(self.counts).join(moved, by, "full").select(*by, had.alias("had"), (had + F.coalesce("d", F.lit(0).cast("long"))).alias("tf")))
        presence = cut(both.where("(had > 0) <> (tf > 0)").select(*by, F.when(F.col("tf") > 0, 1).otherwise(-1).cast("long").alias("e")))
        delta = large(self.inner.select("row_id", "term")).join(sized(presence), "term").groupBy("individual_id", "row_id", "label").agg(F.sum("e").alias("score"))
        scores = inherited(self.scores).unionByName(delta).groupBy("individual_id", "row_id", "label").agg(F.sum("score").alias("score")).where("score <> 0")
        self.changed = presence.count()
        self.genes, self.seams, self.counts, self.scores = genes, across, both.where("tf > 0").drop("had"), cut(scores)

    def fitness(self, rows: DataFrame, labels: DataFrame | None, members: list[int]) -> DataFrame:
        """(individual_id, accuracy, macro_f1) of some members on all rows."""
        mine = F.col("individual_id").isin(members)
        first = self.counts.where(mine).groupBy("individual_id").agg(F.min("label").alias("fallback"))
        return judged(self.scores.where(mine), first, rows, labels)


def goal_fitness(metric: Column, goal: str) -> Column:
    """What is maximised: the metric, or what it lacks to one; null, which sorts last, where it failed."""
    return metric if goal == "maximize" else 1 - metric


def elite(fit: DataFrame, population: int, rate: float) -> DataFrame:
    """(individual_id, fitness) of the best int(population * rate)."""
    return fit.where("fitness is not null").orderBy(F.col("fitness").desc(), "individual_id").limit(int(population * rate))


def tournament(fit: DataFrame, population: int, rounds: int, size: int, seed=42) -> DataFrame:
    """(slot, individual_id): winners of `rounds` draws of `size` with replacement; the first drawn of equals."""
    slots = fit.sparkSession.range(rounds).select(F.col("id").cast("int").alias("slot"))
    draws = slots.select("slot", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: draw_int(population, seed, F.col("slot"), k))).alias("k", "individual_id"))
    joined = draws.join(fit, "individual_id", "left")
    first = F.struct(F.col("fitness").isNull().alias("failed"), (-F.col("fitness")).alias("f"), "k", "individual_id")
    return joined.groupBy("slot").agg(F.min(first).alias("w")).select("slot", F.col("w.individual_id").alias("individual_id"))


def crossover(pairs: DataFrame, seed=42) -> DataFrame:
    """(pair, child, genes): one-point children of (pair, a, b), arrays of equal length without repeats.

    A child drops its second copies, then takes the parents' other genes in order. Arrays of one gene are copied.
    """
    n = F.size("a")
    cut_at = F.when(n > 1, F.lit(1) + draw_int(F.greatest(n - 1, F.lit(1)), seed, F.col("pair"))).otherwise(n)
    rows = pairs.withColumn("n", n).withColumn("c", cut_at)

    def child(x: str, y: str) -> Column:
        own = F.array_distinct(F.concat(F.slice(x, 1, F.col("c")), F.slice(y, F.col("c") + 1, F.greatest(F.col("n") - F.col("c"), F.lit(0)))))
        return F.slice(F.concat(own, F.array_except(F.array_union(x, y), own)), 1, F.col("n"))

    return rows.select("pair", F.posexplode(F.array(child("a", "b"), child("b", "a"))).alias("child", "genes"))


def mutation(genes: DataFrame, rows: DataFrame, strength: int, seed=42) -> DataFrame:
    """genes with the `strength` positions drawn replaced by rows outside the individual, drawn too.

    An individual's rows come in the order of their draws, which are even: those outside it that it wants have draws below
    some share. A task keeps only rows below it; the share grows until all individuals have enough.
    """
    by = Window.partitionBy("individual_id")
    marked = genes.withColumn("k", F.row_number().over(by.orderBy(draw(seed, F.col("individual_id"), F.lit("p"), F.col("gene_pos")), "gene_pos")))
    sizes = [(r.individual_id, r["count"]) for r in genes.groupBy("individual_id").count().collect()]  # a row for each individual
    n, most = rows.count(), max((c for _, c in sizes), default=0)
    ids = F.array(*[F.lit(i) for i, _ in sizes]) if sizes else F.array().cast("array<int>")
    share = min(1.0, (2 * strength + 50) / max(1, n - most))
    while True:
        key = draw(seed, F.col("individual_id"), F.lit("r"), F.col("row_id"))
        each = rows.select("row_id", F.explode(ids).alias("individual_id")).withColumn("d", key)
        if share < 1:
            each = each.where(F.col("d") < F.lit(f"{int(share * (1 << 32)):08x}"))
        outside = cut(each.join(genes.select("individual_id", "row_id"), ["individual_id", "row_id"], "left_anti"))
        found = {r.individual_id: r["count"] for r in outside.groupBy("individual_id").count().collect()}
        if share >= 1 or all(found.get(i, 0) >= strength for i, _ in sizes):
            break
        share = min(1.0, 4 * share)
    fresh = outside.withColumn("k", F.row_number().over(by.orderBy("d", "row_id"))).where(F.col("k") <= strength).drop("d")
    out = marked.join(fresh.withColumnRenamed("row_id", "new"), ["individual_id", "k"], "left")
    return out.select("individual_id", "gene_pos", F.when(F.col("k") <= strength, F.coalesce("new", "row_id")).otherwise(F.col("row_id")).alias("row_id"))


def generation_stats(log: DataFrame) -> DataFrame:
    """(generation, max/avg/min of acc and f1) over finite values."""
    from .curves import finite

    a, f = finite(F.col("acc")), finite(F.col("f1"))
    return log.groupBy("generation").agg(F.max(a).alias("max_acc"), F.avg(a).alias("avg_acc"), F.min(a).alias("min_acc"), F.max(f).alias("max_f1"), F.avg(f).alias("avg_f1"), F.min(f).alias("min_f1"))


def best_overall(log: DataFrame, metric: str, goal: str) -> DataFrame:
    """One row: the best real metric, and the first generation and individual that had it."""
    from .curves import finite

    rows = log.withColumn("m", finite(F.col(metric))).where("m is not null")
    key = -F.col("m") if goal == "maximize" else F.col("m")
    return rows.agg(F.min(F.struct(key.alias("k"), "generation", "individual_id", "m")).alias("b")).select("b.generation", "b.individual_id", F.col("b.m").alias("best"))


def profiles(genes: DataFrame, rows: DataFrame) -> DataFrame:
    """(individual_id, l0_size, num_tokens, num_distinct_tokens, num_classes_in_l0, most_frequent_class_in_l0, l0_indices_hash)."""
    joined = few(genes).join(large(rows), "row_id")
    each = joined.groupBy("individual_id").agg(F.count("*").alias("l0_size"), F.count_distinct("label").alias("num_classes_in_l0"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("row_id")), ","), 256), 1, 10).alias("l0_indices_hash"))
    toks = joined.select("individual_id", F.explode(words(F.col("text"))).alias("w")).groupBy("individual_id").agg(F.count("*").alias("num_tokens"), F.count_distinct("w").alias("num_distinct_tokens"))
    modes = joined.groupBy("individual_id", "label").agg(F.count("*").alias("n"), F.min("gene_pos").alias("first")).groupBy("individual_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "label")).alias("m"))
    out = each.join(toks, "individual_id", "left").join(modes, "individual_id")
    return out.select("individual_id", "l0_size", F.coalesce("num_tokens", F.lit(0)).alias("num_tokens"), F.coalesce("num_distinct_tokens", F.lit(0)).alias("num_distinct_tokens"), "num_classes_in_l0", F.col("m.label").alias("most_frequent_class_in_l0"), "l0_indices_hash")


def set_keys(genes: DataFrame) -> DataFrame:
    """(individual_id, key): equal for individuals of the same rows; sums of two hashes, so no set is gathered."""
    sums = [F.sum(F.xxhash64(F.lit(k), F.col("row_id")).cast("decimal(38,0)")).cast("string") for k in (0, 1)]
    return genes.groupBy("individual_id").agg(F.concat_ws(":", F.count("*").cast("string"), *sums).alias("key"))


def model_fitness(genes: DataFrame, rows: DataFrame, classifier: dict, labels: DataFrame) -> tuple[float, float]:
    """(accuracy, macro F1) on all rows of one individual's model, of any kind that get_model knows."""
    model = get_model(classifier).fit(rows.join(genes.select("row_id"), "row_id", "left_semi"))
    return evaluate.metrics(evaluate.paired(rows, model.predict(rows)), labels)


DETAILS = ("generation", "individual_id", "l0_size", "accuracy_on_full", "f1_macro_on_full", "num_tokens", "num_distinct_tokens", "num_classes_in_l0", "most_frequent_class_in_l0", "l0_indices_hash", "fitness_calc_time_sec")


def details(genes: DataFrame, rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows of the detailed log. scores: (generation, individual_id, acc, f1, seconds); metrics that failed read Error."""
    text = lambda c, places: F.format_string(f"%.{places}f", F.col(c))
    real = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), text(c, 6)).otherwise("Error")
    joined = profiles(genes, rows).join(F.broadcast(scores), "individual_id")  # a row for each individual
    joined = joined.select("*", real("acc").alias("accuracy_on_full"), real("f1").alias("f1_macro_on_full"), F.coalesce(text("seconds", 4), F.lit("N/A")).alias("fitness_calc_time_sec"))
    return joined.select(*DETAILS).orderBy("individual_id")


@dataclass
class GeneticOptimizer:
    """metric: accuracy or macro_f1; goal: maximize or minimize. What starts from a set is judged on all rows.

    Without a classifier, individuals are binary term profiles on n-grams low to high, each derived from its parent's (see
    Lineage) and judged `at_once` in a job; with one (a configuration for get_model, and an embedder for models of vectors), each is a model of its own.
    """

    size: int
    population: int = 50
    generations: int = 100
    crossover_rate: float = 0.7
    mutation_rate: float = 0.1
    mutation_strength: int = 1
    elitism_rate: float = 0.1
    tournament_size: int = 3
    metric: str = "accuracy"
    goal: str = "maximize"
    seed: int = 42
    low: int = 1
    high: int = 2
    at_once: int = 10  # individuals scored in one job
    classifier: dict | None = None
    embedder: object | None = None
    labels: list | None = None  # all labels that F1 averages; by default those of the rows
    log_path: str | None = None  # a CSV folder for the detailed log

    def __post_init__(self):
        if self.metric not in ("accuracy", "macro_f1") or self.goal not in ("maximize", "minimize"):
            raise ValueError("metric is accuracy or macro_f1, goal is maximize or minimize")
        if self.size < 1 or self.population < 1:
            raise ValueError("size and population are positive")
        if not 0 <= self.elitism_rate < 1:
            raise ValueError("elitism_rate is from 0 to below 1")

    def run(self, rows: DataFrame) -> GeneticOptimizer:
        """rows: (row_id, text, label), and vec for models of vectors without an embedder. Fills log, history, best and best_metric.

        The driver holds a few numbers for each individual; genes stay a table.
        """
        spark = rows.sparkSession
        if self.embedder is not None:
            rows = cut(rows.join(self.embedder.transform(rows), "row_id"))
        labels = cut(rows.select("label").distinct()) if self.labels is None else spark.createDataFrame([(x,) for x in sorted(set(self.labels))], f"label {rows.schema['label'].dataType.simpleString()}")
        if rows.count() < self.size:
            raise ValueError("size is greater than the number of rows")
        line = Lineage(rows, self.low, self.high) if self.classifier is None else None
        genes, parents = cut(init_population(rows, self.size, self.population, self.seed)), {}
        memo: dict[str, tuple] = {}
        self.history, self.log, self.best_genes, self.best_metric, self.changed = [], [], None, None, []
        for g in range(self.generations):
            began = time.time()
            keys = {r.individual_id: r.key for r in set_keys(genes).collect()}  # a row for each individual
            first: dict[str, int] = {}  # equal sets are scored once
            for i in sorted(keys):
                if keys[i] not in memo:
                    first.setdefault(keys[i], i)
            if line is not None:
                line.move(genes, parents)
                self.changed.append(line.changed)
            for i, found in self._scored(genes, rows, line, labels, sorted(first.values())):
                memo[keys[i]] = found
            scored = {i: memo.get(k, (None, None, None)) for i, k in keys.items()}
            column = 0 if self.metric == "accuracy" else 1
            best = None
            for i, (acc, f1, _) in sorted(scored.items()):
                self.log.append((g, i, acc, f1))
                m = (acc, f1)[column]
                if m is not None and (self.best_metric is None or (m > self.best_metric if self.goal == "maximize" else m < self.best_metric)):
                    self.best_metric, best = m, i
            if best is not None:
                self.best_genes = genes.where(F.col("individual_id") == best).select("gene_pos", "row_id")
            if self.log_path:
                scores = spark.createDataFrame([(g, i, *v) for i, v in sorted(scored.items())], "generation int, individual_id int, acc double, f1 double, seconds double")
                append_csv(details(genes, rows, scores), self.log_path)
            self.history.append((g, *_stats(scored, 0), *_stats(scored, 1), time.time() - began))
            if g + 1 < self.generations:
                genes, parents = self._next(rows, scored, genes, column, g)
                genes = cut(genes)
        return self

    @property
    def best(self) -> list | None:
        """The best set's row ids, in the order of its genes."""
        return None if self.best_genes is None else [r.row_id for r in self.best_genes.orderBy("gene_pos").collect()]

    def _scored(self, genes: DataFrame, rows: DataFrame, line: Lineage | None, labels: DataFrame, todo: list[int]) -> Iterator[tuple[int, tuple]]:
        """(individual, (accuracy, macro F1, seconds)); None for what failed."""
        if self.classifier is not None:
            for i in todo:
                began = time.time()
                try:
                    found = model_fitness(genes.where(F.col("individual_id") == i), rows, self.classifier, labels)
                except Exception:  # a set of which no model can be made, such as one of a single class
                    found = (None, None)
                yield i, (*found, time.time() - began)
            return
        for at in range(0, len(todo), self.at_once):
            began, part = time.time(), todo[at : at + self.at_once]
            for r in line.fitness(rows, labels, part).collect():
                yield r.individual_id, (r.accuracy, r.macro_f1, (time.time() - began) / len(part))

    def _next(self, rows: DataFrame, scored: dict, genes: DataFrame, column: int, g: int) -> tuple[DataFrame, dict[int, int]]:
        """The next generation's genes, and of each member the one in this generation that it has its first genes from."""
        spark, seed = rows.sparkSession, f"{self.seed}-{g}"
        valid = {i: v[column] if self.goal == "maximize" else 1 - v[column] for i, v in scored.items() if v[column] is not None}
        if not valid:
            return init_population(rows, self.size, self.population, seed), {}
        fit = spark.createDataFrame([(i, valid.get(i)) for i in sorted(scored)], "individual_id int, fitness double")
        best = [r.individual_id for r in elite(fit, self.population, self.elitism_rate).collect()]
        pairs = math.ceil((self.population - len(best)) / 2)
        parents = {r.slot: r.individual_id for r in tournament(fit, len(scored), 2 * pairs, self.tournament_size, seed).collect()}
        people = cut(genes.groupBy("individual_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("gene_pos", "row_id"))), lambda s: s["row_id"]).alias("genes")))  # `size` ids each
        of = lambda name: people.select(F.col("individual_id").alias(f"{name}_id"), F.col("genes").alias(name))
        couples = spark.createDataFrame([(p, parents[2 * p], parents[2 * p + 1]) for p in range(pairs)], "pair int, a_id int, b_id int")
        couples = couples.join(of("a"), "a_id").join(of("b"), "b_id").select("pair", "a", "b")
        mates = draw_unit(seed, F.lit("x"), F.col("pair")) < self.crossover_rate
        mixed = crossover(couples.where(mates), seed).unionByName(couples.where(~mates).select("pair", F.posexplode(F.array("a", "b")).alias("child", "genes")))
        children = mixed.select((F.lit(len(best)) + 2 * F.col("pair") + F.col("child")).cast("int").alias("individual_id"), "genes").where(F.col("individual_id") < self.population)
        long = children.select("individual_id", F.posexplode("genes").alias("gene_pos", "row_id"))
        mutates = draw_unit(seed, F.lit("m"), F.col("individual_id")) < self.mutation_rate
        strength = min(self.mutation_strength, self.size)
        changed = mutation(long.where(mutates), rows, strength, seed).unionByName(long.where(~mutates))
        places = spark.createDataFrame([(i, k) for k, i in enumerate(best)], "individual_id int, place int")
        kept = genes.join(F.broadcast(places), "individual_id").select(F.col("place").alias("individual_id"), "gene_pos", "row_id")  # places: the elite
        origin = dict(enumerate(best)) | {len(best) + k: parents[k] for k in range(2 * pairs) if len(best) + k < self.population}
        return kept.unionByName(changed).select("individual_id", F.col("gene_pos").cast("int").alias("gene_pos"), "row_id"), origin


def _stats(scored: dict, k: int) -> tuple:
    found = [v[k] for v in scored.values() if v[k] is not None and math.isfinite(v[k])]
    return (max(found), sum(found) / len(found), min(found)) if found else (None, None, None)


HISTORY = "generation int, max_acc double, avg_acc double, min_acc double, max_f1 double, avg_f1 double, min_f1 double, generation_time_sec double"


def run_goals(rows: DataFrame, folder: str, settings: dict, goals=(("accuracy", "maximize"), ("accuracy", "minimize"), ("macro_f1", "maximize"), ("macro_f1", "minimize")), csv: bool = False) -> list[tuple[str, bool]]:
    """Each goal's search, with seeds 100 apart, unless both its tables are there already. Returns (name, ran).

    csv: beside each Parquet table, the same as CSV with a header, in a folder of its name and `_csv`.
    """
    spark, out = rows.sparkSession, []

    def keep(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)
        if csv:
            spark.read.parquet(path).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}_csv")

    for k, (metric, goal) in enumerate(goals):
        name = f"{metric}_{goal}"
        if written(spark, f"{folder}/{name}/best") and written(spark, f"{folder}/{name}/history"):
            out.append((name, False))
            continue
        found = GeneticOptimizer(metric=metric, goal=goal, **(settings | {"seed": settings.get("seed", 42) + 100 * k})).run(rows)
        if found.best_genes is None:
            chosen = rows.select("row_id").limit(0).withColumn("gene_pos", F.lit(0))
        else:
            chosen = found.best_genes
        keep(best_rows(rows, chosen, found.best_metric, metric, goal), f"{folder}/{name}/best")
        keep(spark.createDataFrame(found.history, HISTORY), f"{folder}/{name}/history")
        out.append((name, True))
    return out


def best_rows(rows: DataFrame, chosen: DataFrame, value, metric: str, goal: str) -> DataFrame:
    """The chosen rows with the value that they reach, and all their ids as one text."""
    ids = chosen.agg(F.array_join(F.array_sort(F.collect_list("row_id")), ",").alias("l0_indices_str"))  # one row, of the set's size
    kept = rows.join(chosen.select("row_id"), "row_id", "left_semi")
    return kept.join(F.broadcast(ids), F.lit(True)).select("row_id", "text", "label", F.lit(value).cast("double").alias("metric_value"), F.lit(metric.upper()).alias("metric_type"), F.lit(goal.upper()).alias("optimization_goal"), "l0_indices_str")
