"""Soft-membership mixing.

A multinomial naive Bayes classifier over hashed words, fitted on the labelled documents, gives each document a
posterior over domains; its temperature is the one with the least held-out log loss. Document rates r >= 0 are then
fitted by projected gradient least squares, so that the expected tokens of each domain, the sum of tokens * posterior * rate,
meet the targets. A rate depends on a document's posterior and on one short vector for each step: rates need no join and no stored column, and each step is one
distributed sum over the table of posteriors. A pass tries the gradient at many lengths, and preconditioned by the domains' second moments (a few numbers), and keeps what leaves
the least residual, so the residual falls with each step; where targets can't be met, it comes near the least one (tests: within 0.005 of the squared goal). A rate becomes floor(rate) copies and one more by a hash draw of the id.

Defined results: null or wordless texts have no tokens, the prior as their posterior and are never drawn; a domain that no labelled
document has can't be reached and keeps its residual; with no labelled rows all rates are the same; targets are scaled to sum to 1;
a null id draws like any other value; repeated rows get the same rate and draw; extra columns are kept, and where docs has columns of the result's names, the new ones get underscores before theirs;
an id labelled with several domains has the first by name; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, text

BUCKETS = 1 << 13
_U = np.uint64


def _documents(texts: pa.Array):
    """(first row, word bucket of each word, first word of each document) by chunk."""
    for a, t in text.chunks(texts):
        h, at = text.words(t)
        yield a, (h >> _U(64 - 13)).astype(np.int64), at


@dataclass
class Mixer:
    domains: list[str]
    prior: np.ndarray
    loglik: np.ndarray
    temperature: float = 1.0
    steps: list[np.ndarray] = field(default_factory=list)

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words, log-likelihood of each domain) of each text."""
        n, out = [np.zeros(0, np.int64)], [np.zeros((0, len(self.domains)))]
        for _, bucket, at in _documents(texts):
            size = np.diff(at)
            sums = np.zeros((len(size), len(self.domains)))
            full = np.flatnonzero(size)
            if len(full):
                for d in range(len(self.domains)):
                    sums[full, d] = np.add.reduceat(self.loglik[d][bucket], at[:-1][full])
            n.append(size)
            out.append(sums)
        return np.concatenate(n), np.concatenate(out)

    def soften(self, evidence: np.ndarray, temperature: float | None = None) -> np.ndarray:
        x = np.log(self.prior) + evidence * (self.temperature if temperature is None else temperature)
        x = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
        return x / x.sum(1, keepdims=True) if len(x) else x

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = np.ones(len(p))
        for s in self.steps:
            r = np.maximum(0.0, r - p @ s)
        return r


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 40_000) -> Mixer:
    """labelled: (id_col, domain). Counts are summed over partitions; at most max_labelled rows are used, by the hash of their id."""
    k = len(domains)
    marks = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).dropna().filter(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    marks = store.materialise(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "marks")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marks), "doc_id").withColumn("held", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)) < 2).cast("int"))

    def sums(batches):
        counts, seen = np.zeros((k, BUCKETS), np.int64), np.zeros(k, np.int64)
        for b in batches:
            who = np.array([domains.index(x) for x in b.column("domain").to_pylist()], np.int64)
            fit = np.asarray(b.column("held")) == 0
            for a, bucket, at in _documents(b.column("text")):
                size = np.diff(at)
                mine, used = who[a : a + len(size)], fit[a : a + len(size)]
                word = np.repeat(used, size)
                counts += np.bincount((np.repeat(mine, size) * BUCKETS + bucket)[word], minlength=k * BUCKETS).reshape(k, BUCKETS)
                seen += np.bincount(mine[used], minlength=k)
        d, w = np.nonzero(counts)
        d, w, n = np.concatenate([d, np.arange(k)]), np.concatenate([w, np.full(k, -1)]), np.concatenate([counts[d, w], seen])
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(w, pa.int32()), pa.array(n)], ["d", "w", "n"])

    store.small_batches(docs.sparkSession)
    flat = rows.mapInArrow(text.tidied(sums), "d int, w int, n long").groupBy("d", "w").agg(F.sum("n").alias("n")).collect()  # at most (BUCKETS + 1) a domain; w is -1 for documents
    counts, seen = np.zeros((k, BUCKETS)), np.zeros(k)
    for r in flat:
        if r.w < 0:
            seen[r.d] = r.n
        else:
            counts[r.d, r.w] = r.n
    smooth = counts + 0.5
    mixer = Mixer(domains, (seen + 1) / (seen.sum() + k), np.log(smooth / smooth.sum(1, keepdims=True)))
    grid = [1.0, 0.3, 0.1, 0.03, 0.01, 0.003]

    def loss(batches):
        total = np.zeros(len(grid))
        for b in batches:
            held = np.asarray(b.column("held")) == 1
            who = np.array([domains.index(x) for x in b.column("domain").to_pylist()], np.int64)
            _, e = mixer.evidence(b.column("text").filter(pa.array(held)))
            for g, t in enumerate(grid):
                p = mixer.soften(e, t)
                total[g] -= np.log(np.maximum(p[np.arange(len(p)), who[held]], 1e-12)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(total)], ["g", "loss"])

    lost = {r.g: r.loss for r in rows.filter("held = 1").mapInArrow(text.tidied(loss), "g int, loss double").groupBy("g").agg(F.sum("loss").alias("loss")).collect()}
    if any(lost.values()):
        mixer.temperature = grid[min(lost, key=lambda g: (lost[g], g))]
    store.discard(marks)
    return mixer


def fit_rates(docs: DataFrame, mixer: Mixer, targets: dict[str, float], tokens: float | None = None, text_col: str = "text", rounds: int = 30, tolerance: float = 1e-6) -> Mixer:
    """Adds the gradient steps to mixer. tokens: the expected total; by default that of docs."""
    k = len(mixer.domains)

    def posterior(batches):
        for b in batches:
            n, e = mixer.evidence(b.column(0))
            p = mixer.soften(e)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * k), pa.array(p.ravel()))], ["n", "p"])

    table = store.materialise(docs.select(F.col(text_col).cast("string")).mapInArrow(text.tidied(posterior), "n long, p array<double>"), "posteriors")

    def moments(tried: list[np.ndarray]):
        def run(batches):
            first, second = np.zeros((len(tried), k)), np.zeros((len(tried), k, k))
            for b in batches:
                n, p = np.asarray(b.column(0)).astype(float), np.asarray(b.column(1).flatten()).reshape(-1, k)
                now = mixer.rates(p)
                for c, step in enumerate(tried):
                    r = np.maximum(0.0, now - p @ step)
                    first[c] += (n * r) @ p
                    second[c] += p.T @ (p * (n * (r > 0))[:, None])
            at = np.arange(len(tried) * k)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(first.ravel()), *map(pa.array, second.reshape(-1, k).T)], ["at", "m", *(f"h{i}" for i in range(k))])

        return text.tidied(run)

    schema = ", ".join(["at long", "m double", *(f"h{i} double" for i in range(k))])

    def measured(tried: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each domain after each step that is tried, and the second moments of the documents whose rate it leaves above 0."""
        first, second = np.zeros(len(tried) * k), np.zeros((len(tried) * k, k))
        for r in table.mapInArrow(moments(tried), schema).groupBy("at").agg(F.sum("m").alias("m"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(k)]).collect():
            first[r["at"]], second[r["at"]] = r.m, [r[f"h{i}"] for i in range(k)]
        return first.reshape(-1, k), second.reshape(-1, k, k)

    (now,), (second,) = measured([np.zeros(k)])
    goal = np.array([targets[d] for d in mixer.domains], float)
    goal = goal / goal.sum() * (now.sum() if tokens is None else tokens)
    done, scale = tolerance**2 * float((goal**2).sum()), max(float(np.linalg.eigvalsh(second)[-1]), 1e-12)
    while len(mixer.steps) < rounds and (left := float(((now - goal) ** 2).sum())) > done:
        off = now - goal
        sharp = np.linalg.pinv(second, rcond=1e-9, hermitian=True) @ off
        tried = [sharp * 0.5**j for j in range(4)] + [off / scale * 2.0**j for j in range(-2, 12)]
        got, moment = measured(tried)
        best = int(np.argmin(((got - goal) ** 2).sum(1)))
        if ((got[best] - goal) ** 2).sum() >= left * (1 - 1e-6):
            break
        mixer.steps.append(tried[best])
        now, second = got[best], moment[best]
    store.discard(table)
    return mixer


def columns(mixer: Mixer, column: Column) -> Column:
    """A struct of tokens, posterior and rate for a text column."""

    @F.arrow_udf("tokens long, posterior array<double>, rate double")
    def run(t: pa.Array) -> pa.Array:
        n, e = mixer.evidence(t)
        p = mixer.soften(e)
        rate = np.where(n > 0, mixer.rates(p), 0.0)
        k = len(mixer.domains)
        return pa.StructArray.from_arrays([pa.array(n), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * k), pa.array(p.ravel())), pa.array(rate)], ["tokens", "posterior", "rate"])

    return run.asNondeterministic()(column.cast("string"))  # or a filter on the copies would make the plan run it twice


def copies(rate: Column, key: Column, seed: int = 1992) -> Column:
    """floor(rate) copies and another with the probability of the rest."""
    draw = F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], tokens: float | None = None, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 40_000) -> DataFrame:
    """docs with mix_tokens, mix_posterior (targets' domains in order), mix_rate and mix_copies."""
    mixer = fit_rates(docs, classifier(docs, labelled, sorted(targets), id_col, text_col, max_labelled), targets, tokens, text_col)
    mix = store.free_name(docs, "__mix")
    with_it = docs.withColumn(mix, columns(mixer, docs[text_col]))
    new = [F.col(f"{mix}.{c}").alias(store.free_name(docs, f"mix_{c}")) for c in ("tokens", "posterior", "rate")]
    return with_it.select(*[with_it[c] for c in docs.columns], *new, copies(F.col(f"{mix}.rate"), with_it[id_col]).alias(store.free_name(docs, "mix_copies")))


def repeated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """Each row of docs as often as mixed() gives it, in its own columns."""
    rated = mixed(docs, labelled, targets, **options)
    often, nth = F.col(rated.columns[-1]), store.free_name(rated, "__nth")
    return rated.filter(often > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), often))).select(*docs.columns)
