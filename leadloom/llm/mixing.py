"""Mixing sources to target weights: min-cost flow over membership patterns, then a seeded choice of documents."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import free_name, stored, whole_text

BUCKETS = 4096


def n_words(text_col: str = "text") -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in a text (null: 0)."""
    spaced = F.trim(F.translate(whole_text(text_col), "\t\n\x0b\f\r", "     "))
    return F.when(spaced == "", F.lit(0)).otherwise(F.size(F.split(spaced, " +"))).cast("long")


def target_sizes(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """share * sum(sizes) by weight; targets stop at ``most`` times their size, the excess is shared again."""
    total, capped = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        unit = left / sum(weights[i] for i in free) if free else 0.0
        over = {i for i in free if unit * weights[i] > most * sizes[i]}
        if not over:
            return [most * s if i in capped else unit * weights[i] for i, s in enumerate(sizes)]
        capped |= over


def min_cost_flow(nodes: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (tail, head, capacity, cost) of a cheapest largest flow: successive shortest paths."""
    head, cap, cost, out = [], [], [], [[] for _ in range(nodes)]
    for u, v, c, w in arcs:
        out[u].append(len(head))
        head.append(v), cap.append(c), cost.append(w)
        out[v].append(len(head))
        head.append(u), cap.append(0), cost.append(-w)
    while True:
        far, via, waiting, queued = {source: 0}, {}, deque([source]), {source}
        while waiting:
            u = waiting.popleft()
            queued.discard(u)
            for e in out[u]:
                v = head[e]
                if cap[e] and far[u] + cost[e] < far.get(v, 1 << 60):
                    far[v], via[v] = far[u] + cost[e], e
                    if v not in queued:
                        queued.add(v)
                        waiting.append(v)
        if sink not in far:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = head[via[v] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def route(patterns: dict[tuple, int], quotas: dict, most: int) -> dict[tuple, dict]:
    """Words that each membership pattern gives to each of its sources.

    A pattern's words can be used ``most`` times; the k-th use costs k-1 a word, so repetition is convex and falls
    on patterns only where single use does not fill the quotas.
    """
    names, groups = list(quotas), list(patterns)
    sink, arcs = 1 + len(groups) + len(names), []
    for i, g in enumerate(groups):
        arcs += [(0, 1 + i, patterns[g], k) for k in range(most)]
        arcs += [(1 + i, 1 + len(groups) + names.index(s), most * patterns[g], 0) for s in g]
    arcs += [(1 + len(groups) + j, sink, quotas[s], 0) for j, s in enumerate(names)]
    given: dict[tuple, dict] = {g: {} for g in groups}
    for (u, v, _, _), f in zip(arcs, min_cost_flow(sink + 1, arcs, 0, sink)):
        if 0 < u <= len(groups) and f:
            given[groups[u - 1]][names[v - 1 - len(groups)]] = f
    return given


class Mix:
    """A mix of docs: ``sources`` (with sizes, targets, words given) and a rule that each document can apply alone.

    source_col is a string (one source, null is a source of its own) or an array of strings (a document may belong
    to several). Weights repeat over the sources in order of code points, null last. Empty tables give an empty mix;
    documents without words are taken as often as their neighbours in the seeded order but add no words. Documents of
    equal size and dice (repeated rows) share their fate.

    One row for each membership pattern, with its sums, reaches the driver and is broadcast back, however many
    documents there are: at most ``most_patterns`` (some hundred bytes each), above that the mix is refused. Sources of
    higher cardinality are grouped first: ``group`` maps each source to what is mixed, e.g. a URL's host to its domain.
    """

    def __init__(self, docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
                 weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17, rounds: int = 4,
                 most_patterns: int = 50_000, group: Callable[[Column], Column] | None = None):
        self.source_col, self.text_col, self.id_col, self.most, self.seed = source_col, text_col, id_col, most, seed
        self.spark: SparkSession = docs.sparkSession
        kind = docs.schema[source_col].dataType
        members = F.col(source_col) if isinstance(kind, T.ArrayType) else F.array(F.col(source_col).cast("string"))
        if group:
            members = F.transform(members, lambda m: group(m).cast("string"))
        self.members = F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))
        slim = self._slim(docs).select("pattern", "members", "size", "dice", "_id")
        self.slim = stored(slim, "mixing")
        rows = self.slim.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size")).limit(most_patterns + 1).collect()
        if len(rows) > most_patterns:
            raise ValueError(f"more than {most_patterns} membership patterns; group the sources or raise most_patterns")
        self.patterns = {r["pattern"]: (tuple(r["members"]), r["size"]) for r in rows}
        sums: dict = {}
        for members, size in self.patterns.values():
            for s in members:
                sums[s] = sums.get(s, 0) + size
        names = sorted((s for s in sums if s is not None)) + [None] * (None in sums)
        sizes = [sums[s] for s in names]
        targets = target_sizes(sizes, [weights[i % len(weights)] for i in range(len(names))], share, most) if names else []
        self.sources = {s: {"size": n, "target": t} for s, n, t in zip(names, sizes, targets)}
        quotas = {s: round(t) for s, t in zip(names, targets)}
        self.given = self._route(quotas)
        self.full, self.gap = {}, {}
        for p, (_, size) in self.patterns.items():
            words = sum(self.given[p].values())
            self.full[p] = min(words // size, most) if size else 1
            self.gap[p] = words - self.full[p] * size
        self.rules: dict[str, list[tuple[int, int, int]]] = {p: [] for p in self.patterns}
        for _ in range(rounds):
            if not self._fill():
                break
        self._nearest()

    def _route(self, quotas: dict) -> dict[str, dict]:
        """route() by pattern key; patterns with the same members are one by construction."""
        key_of = {members: p for p, (members, _) in self.patterns.items()}
        given = route({members: size for members, size in self.patterns.values()}, quotas, self.most)
        return {key_of[m]: words for m, words in given.items()}

    def _slim(self, docs: DataFrame) -> DataFrame:
        """Pattern, size and a seeded number of each document, from its own columns alone."""
        text_hash = F.xxhash64(whole_text(self.text_col))
        own = F.col(self.id_col).cast("long")
        return docs.select(
            own.alias("_id"),
            self.members.alias("members"),
            F.to_json(self.members).alias("pattern"),
            n_words(self.text_col).alias("size"),
            F.xxhash64(own, text_hash, F.lit(self.seed)).alias("dice"),
        )

    def _plan(self) -> DataFrame:
        """A row for each pattern: bounded, so documents meet it where they lie and are not shuffled by source."""
        rows = [(p, self.full[p], self.rules[p], self.gap[p]) for p in self.patterns]
        return F.broadcast(self.spark.createDataFrame(rows, "_pattern string, full int, rules array<struct<least:long,most:long,last:long>>, gap long"))

    @staticmethod
    def _chosen(size: str, dice: str, rules: str = "rules") -> Column:
        return F.exists(rules, lambda r: F.col(size).between(r["least"], r["most"]) & (F.col(dice) <= r["last"]))

    def _fill(self) -> bool:
        """One round: in seeded order, of the documents not yet chosen that fit into the gap, as many as fit.

        Running sums are taken over buckets of the seeded number first, and over documents only inside the one
        bucket of each pattern where the gap closes.
        """
        joined = self.slim.join(self._plan(), F.col("pattern") == F.col("_pattern"))
        rest = joined.where((F.col("gap") > 0) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & ~self._chosen("size", "dice"))
        rest = rest.withColumn("bucket", F.shiftright("dice", 64 - BUCKETS.bit_length() + 1))
        sums = rest.groupBy("pattern", "gap", "bucket").agg(F.sum("size").alias("size"))
        sums = sums.withColumn("upto", F.expr("sum(size) over (partition by pattern order by bucket)"))
        closing = sums.where("upto > gap").groupBy("pattern").agg(F.min(F.struct("bucket", F.expr("upto - size as base"))).alias("b"))
        closing = closing.select(F.col("pattern").alias("p"), F.col("b.bucket").alias("last"), F.col("b.base").alias("base"))
        inside = rest.join(F.broadcast(closing), (F.col("pattern") == F.col("p")) & (F.col("bucket") == F.col("last")))
        inside = inside.withColumn("upto", F.expr("base + sum(size) over (partition by pattern order by dice)"))
        cuts = inside.where("upto > gap").groupBy("pattern").agg(F.min("dice").alias("cut"))
        found = rest.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("size").alias("all"))
        rows = found.join(cuts, "pattern", "left").collect()
        for r in rows:
            last = r["cut"] - 1 if r["cut"] is not None else (1 << 63) - 1
            self.rules[r["pattern"]].append((0, self.gap[r["pattern"]], last))
        if not rows:
            return False
        self._measure()
        return True

    def _nearest(self) -> None:
        """The smallest document that does not fit, where the words come nearer to their number with it."""
        rest = self.slim.join(self._plan(), F.col("pattern") == F.col("_pattern"))
        rest = rest.where((F.col("gap") > 0) & (F.col("size") > F.col("gap")) & (F.col("size") < 2 * F.col("gap")) & ~self._chosen("size", "dice"))
        for r in rest.groupBy("pattern").agg(F.min(F.struct("size", "dice")).alias("d")).collect():
            self.rules[r["pattern"]].append((r["d"]["size"], r["d"]["size"], r["d"]["dice"]))

    def _measure(self) -> None:
        taken = self.slim.join(self._plan(), F.col("pattern") == F.col("_pattern")).where(self._chosen("size", "dice"))
        done = {r["pattern"]: r["size"] for r in taken.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
        for p, (_, size) in self.patterns.items():
            self.gap[p] = sum(self.given[p].values()) - self.full[p] * size - done.get(p, 0)

    def documents(self) -> DataFrame:
        """One row per document: doc_id, size, members, taken (words, repeats counted)."""
        joined = self.slim.join(self._plan(), F.col("pattern") == F.col("_pattern"))
        copies = F.col("full") + self._chosen("size", "dice").cast("int")
        return joined.select(F.col("_id").alias("doc_id"), "size", "members", (copies * F.col("size")).alias("taken"))

    def repeat(self, docs: DataFrame) -> DataFrame:
        """docs with each row as often as the mix takes it; the rule needs a row's own columns and the plan: texts stay put."""
        names = {n: free_name(docs, f"_mix_{n}") for n in ("pattern", "size", "dice", "copy", "key", "rule")}
        own, text_hash = F.col(self.id_col).cast("long"), F.xxhash64(whole_text(self.text_col))
        marked = docs.withColumns({
            names["pattern"]: F.to_json(self.members),
            names["size"]: n_words(self.text_col),
            names["dice"]: F.xxhash64(own, text_hash, F.lit(self.seed)),
        })
        plan = self._plan().select(F.col("_pattern").alias(names["key"]), F.struct("full", "rules").alias(names["rule"]))
        joined = marked.join(F.broadcast(plan), F.col(names["pattern"]) == F.col(names["key"]))
        chosen = self._chosen(names["size"], names["dice"], f"{names['rule']}.rules")
        copies = F.col(f"{names['rule']}.full") + chosen.cast("int")
        picked = joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(1), copies)).alias(names["copy"]))
        return picked.drop(names["copy"])


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken for a table in which each document has one source."""
    mix = Mix(docs, **settings)
    rows = [(s, v["size"], float(v["target"])) for s, v in mix.sources.items()]
    sources = mix.spark.createDataFrame(rows, "source string, source_size long, target double")
    taken = mix.documents().withColumn("_source", F.element_at("members", 1))
    joined = taken.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("source")), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
