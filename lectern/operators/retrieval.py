"""Ranking: vectors, trigram BM25, weighted reciprocal ranks, section boost, caps, recall.

Operators take and give DataFrames; what ranks has a score and, for ties, the order in which it was seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.vectors import dot

#: Scores are compared at this many decimals, so that the order of summing doesn't decide.
DIGITS = 9


#: Questions of texts that are asked in one pass: so many at once reach the driver and the tasks, whatever there are.
BLOCK = 1 << 16


def blocks_of(questions: DataFrame, size: int = BLOCK) -> Iterator[pa.Table]:
    """The questions by blocks of about size, dealt by a hash of query_id; one block at a time is on the driver."""
    n = max(1, -(-questions.count() // size))
    for i in range(n):
        found = questions.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow()
        if found.num_rows:
            yield found


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each column's k highest scores, of equals those with the least ids; -inf is none."""
    n = len(scores)
    if n > k:
        kth = np.partition(scores, n - k, axis=0)[n - k]
        keep = (scores >= kth) & (scores > -np.inf)
        for c in np.flatnonzero(keep.sum(0) > k):  # ties at the end
            order = np.lexsort((ids, -scores[:, c]))[:k]
            keep[:, c] = False
            keep[order, c] = True
    else:
        keep = scores > -np.inf
    return np.nonzero(keep)


#: Rows and questions that one task holds at most, and those whose products are made at once.
CELL_ROWS, CELL_QUESTIONS = 1 << 20, 1 << 16
ROWS_AT_ONCE, QUESTIONS_AT_ONCE = 4096, 1024
#: Scores that a task holds before it keeps the best only; k for each question stay in any case.
MOST_HELD = 1 << 20


def most_held(k: int, questions: int) -> int:
    """At least twice what stays, so that the best aren't sought anew after each row where there are many questions."""
    return max(MOST_HELD, 2 * k * questions)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _compared(chunks: DataFrame, questions: DataFrame, k: int | None, by_paper: bool) -> DataFrame:
    """query_id, id, paper_id, score: of each question the best k of every cell of rows, or the best k papers' best rows.

    Rows and questions are dealt to cells by hashes of their ids, and each cell of rows meets each cell of questions in one
    task; how many cells there are follows from the counts, so the plan is the same for any number of questions. What a
    cell gives on is k rows a question. A row meets the questions whose vectors are as wide as its own; null vectors, and
    vectors with a null in them, meet nothing.
    """
    whole = "vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL) AND size(vec) > 0"
    rows, asked = chunks.select("id", "paper_id", "vec").where(whole), questions.select("query_id", "vec").where(whole)
    n, m = rows.count(), asked.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    across = max(-(-n // CELL_ROWS), min(-(-n // ROWS_AT_ONCE), cores), 1)
    down = max(-(-m // CELL_QUESTIONS), 1)
    dealt = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = rows.select("*", F.size("vec").alias("width"), dealt("id", across).alias("across"), every(down).alias("down"))
    asked = asked.select("*", F.size("vec").alias("width"), dealt("query_id", down).alias("down"), every(across).alias("across"))

    def meet(key: tuple, some: pa.Table, questions: pa.Table) -> pa.Table:
        ids, groups = some.column("id").to_numpy(), some.column("paper_id").to_numpy()
        names = questions.column("query_id").to_numpy()
        held: list[list[np.ndarray]] = []
        if len(ids) and len(names):
            order = np.lexsort((ids, groups)) if by_paper else np.arange(len(ids))
            vectors, wanted = _matrix(some.column("vec")), _matrix(questions.column("vec"))
            for q in range(0, len(names), QUESTIONS_AT_ONCE):
                best: list[tuple[np.ndarray, ...]] = []
                for at in range(0, len(order), ROWS_AT_ONCE):
                    part = order[at : at + ROWS_AT_ONCE]
                    scores = np.round(vectors[part] @ wanted[q : q + QUESTIONS_AT_ONCE].T, DIGITS)
                    r, c = _of_papers(scores, groups[part]) if by_paper else _best(scores, ids[part], k)
                    best.append((c, scores[r, c], part[r]))
                    if len(best) == 16 and k is not None:
                        best = [_kept(k, by_paper, best, ids, groups)]
                c, score, r = _kept(k, by_paper, best, ids, groups)
                held.append([names[q + c], ids[r], groups[r], score])
        columns = [np.concatenate(x) for x in zip(*held)] if held else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table(columns, names=["query_id", "id", "paper_id", "score"])

    key = ["width", "across", "down"]
    return rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, "query_id bigint, id bigint, paper_id bigint, score double")


def _of_papers(scores: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each paper's first row with the highest score; rows of a paper stand together."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    size = np.diff(np.append(first, len(groups)))
    is_most = scores == np.repeat(np.maximum.reduceat(scores, first, axis=0), size, axis=0)
    turn = np.where(is_most, np.arange(len(groups))[:, None], len(groups))
    rows = np.minimum.reduceat(turn, first, axis=0)
    return rows.ravel(), np.tile(np.arange(scores.shape[1]), len(first))


def _kept(k: int | None, by_paper: bool, best: list[tuple[np.ndarray, ...]], ids: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, ...]:
    """Question, score and row of what stays: one row for each question and paper, k for each question."""
    c, score, r = (np.concatenate(x) for x in zip(*best))
    if by_paper:
        order = np.lexsort((ids[r], -score, groups[r], c))
        own = np.stack([c[order], groups[r[order]]])
        order = order[np.concatenate([[True], (own[:, 1:] != own[:, :-1]).any(0)])]
        c, score, r = c[order], score[order], r[order]
    if k is not None:
        item = groups[r] if by_paper else ids[r]
        order = np.lexsort((item, -score, c))
        at = np.flatnonzero(np.concatenate([[True], c[order][1:] != c[order][:-1]]))
        order = order[np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order)))) < k]
        c, score, r = c[order], score[order], r[order]
    return c, score, r


def nearest(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """query_id, id, paper_id, score, pos (from 0): each question's k chunks with the highest product, of equals those with
    the least id. chunks: id, paper_id, vec. questions: query_id, vec. No chunks or no questions, no rows."""
    return top(_compared(chunks, questions, k, by_paper=False), k, "id", by=["query_id"])


def nearest_of_group(chunks: DataFrame, questions: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, paper_id, id, score: for each question each paper's chunk with the highest product, the first of equals;
    of the k best papers where k is given. A paper that isn't among the k of any cell can't be among the k of all."""
    best = best_of_group(_compared(chunks, questions, k, by_paper=True), ["query_id", "paper_id"], "id")
    return best if k is None else top(best, k, "paper_id", by=["query_id"]).drop("pos")


def text_search(texts: DataFrame, questions: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, score, pos: each question's k texts with the highest score, as bm25() gives it for the question's terms.

    texts: id, text. questions: query_id, terms. All terms are looked for together in one walk over a text (Aho-Corasick,
    of the package ahocorasick); two passes over the texts, one that finds in how many each term is, one that scores, do for
    BLOCK questions. A text's scores for all questions are sums of its terms' weights, and what a task's k best so far leave
    out goes at once. A task gives on k texts a question. A null text is empty; a question without terms of three
    characters has no rows.
    """
    low = texts.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    n, mean = low.agg(F.count("*"), F.avg(F.greatest(F.length("text") - 2, F.lit(0)))).first()
    out = None
    for block in blocks_of(questions.select("query_id", "terms")):
        asked = [[t.lower() for t in dict.fromkeys(terms or []) if t and len(t) >= 3] for terms in block.column("terms").to_pylist()]
        place = {t: i for i, t in enumerate(sorted({t for own in asked for t in own}))}
        if place:
            part = _scored_block(low, block.column("query_id").to_numpy(), asked, place, n, mean, k, k1, b)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = low.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score")).limit(0)
    return top(out, k, "id", by=["query_id"])


def _finder(terms: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(t, i)
    found.make_automaton()
    return found


def _scored_block(low: DataFrame, names: np.ndarray, asked: list[list[str]], place: dict[str, int], n: int, mean: float, k: int, k1: float, b: float) -> DataFrame:
    terms = list(place)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = _finder(terms), np.zeros(len(terms), np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total[list({i for _, i in held.iter(text)})] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    df = np.zeros(len(terms))
    for r in low.select("text").mapInArrow(frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term
        df[r["term"]] = r["df"]
    raw = np.log((n - df + 0.5) / (df + 0.5))
    idf = np.where(raw > 0, raw, 1e-6)
    # Which questions ask for each term, one list behind the other.
    pairs = np.array([(place[t], q) for q, own in enumerate(asked) for t in own])
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    first = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
    by_term = pairs[:, 1]

    # Each question's terms in order, a column a question; where there are fewer, one that no text has.
    width = max(len(own) for own in asked)
    wanted = np.full((width, len(asked)), len(terms))
    for q, own in enumerate(asked):
        wanted[: len(own), q] = sorted(place[t] for t in own)
    room = most_held(k, len(asked))

    def best(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        q, ids, score = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((ids, -score, q))
        at = np.flatnonzero(np.concatenate([[True], q[order][1:] != q[order][:-1]]))
        order = order[np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order)))) < k]
        return q[order], ids[order], score[order]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, size = _finder(terms), [], 0
        weight, every = np.zeros(len(terms) + 1), np.arange(len(asked))
        least = np.full(len(asked), -np.inf)  # what a score must reach to be among this task's k best so far
        for batch in batches:
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                hits = [i for _, i in held.iter(text)]
                if not hits:
                    continue
                t, tf = np.unique(hits, return_counts=True)
                weight[t] = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * max(len(text) - 2, 0) / mean))
                q = every
                if 8 * (first[t + 1] - first[t]).sum() < len(every):
                    q = np.unique(np.concatenate([by_term[first[i] : first[i + 1]] for i in t]))
                own = wanted if q is every else wanted[:, q]
                score = weight[own[0]]
                for line in own[1:]:
                    score += weight[line]
                weight[t] = 0.0
                some = np.flatnonzero((score > 0) & (score >= least[q] - 10.0**-DIGITS))
                q, score = q[some], np.round(score[some], DIGITS)
                some = score >= least[q]
                q, score = q[some], score[some]
                found.append((q, np.full(len(q), id_), score))
                size += len(q)
                if size > room:
                    found = [best(found)]
                    size = len(found[0][0])
                    q, at, n = np.unique(found[0][0], return_index=True, return_counts=True)
                    full = n == k
                    least[q[full]] = found[0][2][at[full] + k - 1]
        if found:
            q, ids, score = best(found)
            for at in range(0, len(q), ROWS_AT_ONCE):
                part = slice(at, at + ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([pa.array(names[q[part]]), pa.array(ids[part]), pa.array(score[part])], names=["query_id", "id", "score"])

    return low.mapInArrow(scored, "query_id bigint, id bigint, score double")


def similarity(chunks: DataFrame, query: list[float], vec: str = "vec") -> DataFrame:
    """chunks with score: the product with one query vector. The vector is a literal, so there is no join."""
    return chunks.withColumn("score", F.round(dot(F.col(vec), F.array(*map(F.lit, map(float, query)))), DIGITS))


def top(ranked: DataFrame, k: int, *ties: str, by: list[str] | None = None) -> DataFrame:
    """The k best by score, of each by where it is given; pos from 0."""
    order = [F.desc("score"), *ties]
    best = ranked if by else ranked.orderBy(*order).limit(k)
    window = W.partitionBy(*by).orderBy(*order) if by else W.orderBy(*order)
    # The bare number is compared, so that each task already keeps k rows of a group at most.
    return best.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= k).withColumn("pos", (F.col("_n") - 1).cast("long")).drop("_n")


def best_of_group(scored: DataFrame, group: str | list[str], item: str) -> DataFrame:
    """Each group's item with the highest score, the first of equals."""
    return scored.groupBy(*_listed(group)).agg(F.max_by(item, F.struct("score", -F.col(item))).alias(item), F.max("score").alias("score"))


def _listed(x: str | list[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def bm25(df: DataFrame, texts: list[str], terms: list[str], key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the rows in which a term occurs, as trigram-tokenised full-text search ranks them.

    A term of three characters or more matches as a substring, whatever its case. The length of a row is its number of
    trigrams over all text columns. A term in more than half of the rows counts next to nothing. Shorter terms match
    nothing. One pass finds all frequencies, one scores; only one row of statistics is handed over.
    """
    terms = [t.lower() for t in dict.fromkeys(terms) if len(t) >= 3]
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in texts]
    occurs = lambda t: sum((_overlapping(c, t) for c in low), F.lit(0))
    size = sum((F.greatest(F.length(c) - 2, F.lit(0)) for c in low), F.lit(0))
    counted = df.select(F.col(key), size.alias("size"), *[occurs(t).alias(f"t{i}") for i, t in enumerate(terms)])
    if not terms:
        return counted.select(key, F.lit(0.0).alias("score")).limit(0)
    stats = counted.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = counted.join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        raw = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"t{i}").cast("double")
        score = score + F.when(raw > 0, raw).otherwise(1e-6) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    some = " OR ".join(f"t{i} > 0" for i in range(len(terms)))
    return joined.where(some).select(key, F.round(score, DIGITS).alias("score"))


def _overlapping(c: Column, term: str) -> Column:
    """Occurrences of term, overlapping ones too."""
    if any(term[i:] == term[: len(term) - i] for i in range(1, len(term))):
        return F.regexp_count(c, F.lit("(?=" + "".join(f"\\x{{{ord(x):x}}}" for x in term) + ")"))
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")


def fuse(lists: list[tuple[DataFrame, float]], key: str | list[str], k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion. Each list: key, pos (from 0). Gives key, score, seen (by list, then place)."""
    key = _listed(key)
    parts = [df.select(*key, (F.lit(w) / (k + F.col("pos"))).alias("s"), (F.lit(i * 1_000_000).cast("long") + F.col("pos")).alias("seen")) for i, (df, w) in enumerate(lists)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(*key).agg(F.round(F.sum("s"), DIGITS).alias("score"), F.min("seen").alias("seen"))


def weights(intent: str) -> tuple[float, float]:
    """Of the vector list and of the text list."""
    return (0.75, 1.25) if intent == "exact" else (1.0, 1.0)


def section_boost(ranked: DataFrame, section: list[str], share: float = 0.08, named: str | None = None) -> DataFrame:
    """Adds to each score a share of the scores of its section together. named: the column that must not be empty."""
    group = F.sum("score").over(W.partitionBy(*section))
    if named:
        group = F.when(F.col(named) != "", group).otherwise(F.lit(0.0))
    return ranked.withColumn("boosted", F.round(F.col("score") + share * group, DIGITS))


def capped(ranked: DataFrame, group: str | list[str], most: int, order: list[Column]) -> DataFrame:
    """At most so many of each group, the first in order."""
    return ranked.withColumn("_n", F.row_number().over(W.partitionBy(*_listed(group)).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def rerank(ranked: DataFrame, score_pairs: Callable[[DataFrame], DataFrame] | None, head: int = 40, by: list[str] | None = None) -> DataFrame:
    """ranked (with pos) in the order of a model for the first head rows (of each by); the rest stays behind, as it was. Rows
    that the model doesn't score come last of the head. No model: nothing changes. Without by all rows are one list."""
    if score_pairs is None:
        return ranked
    scored = score_pairs(ranked.where(F.col("pos") < head))
    order = [F.col("pos") >= head, F.desc(F.when(F.col("pos") < head, F.coalesce("model_score", F.lit(-1e9)))), F.col("pos")]
    window = W.partitionBy(*by).orderBy(*order) if by else W.orderBy(*order)
    rest = ranked.where(F.col("pos") >= head).withColumn("model_score", F.lit(None).cast("double"))
    return scored.unionByName(rest).withColumn("pos", (F.row_number().over(window) - 1).cast("long"))


def recall(
    best: DataFrame, paper_scores: DataFrame, title_hits: DataFrame, covered: DataFrame, room: int, with_chunks: Column, bonus: float = 0.35, floor: float = 0.3, by: list[str] | None = None,
) -> DataFrame:
    """Papers that the ranking doesn't cover yet: paper_id, score, the room best of them (for each by where it is given).

    The score is the better of the best chunk's and the paper's own, and a bonus where the title is hit. A paper without
    chunks must score above floor. best, paper_scores: paper_id, score; of equal papers the higher holds. Both need only
    hold the best papers (as many as room and what is covered) and those whose titles are hit: others can't come in.
    """
    key = [*(by or []), "paper_id"]
    a, b = best.groupBy(*key).agg(F.max("score").alias("chunk_score")), paper_scores.groupBy(*key).agg(F.max("score").alias("own_score"))
    all_ = a.join(b, key, "full").join(title_hits.select(*key).distinct().withColumn("hit", F.lit(True)), key, "left")
    score = F.greatest(F.coalesce("chunk_score", F.lit(-1.0)), F.coalesce("own_score", F.lit(-1.0))) + F.when(F.col("hit"), bonus).otherwise(0.0)
    scored = all_.join(covered.select(*key).distinct(), key, "left_anti").select(*key, F.round(score, DIGITS).alias("score"), with_chunks.alias("has_chunks"))
    return top(scored.where(F.col("has_chunks") | (F.col("score") > floor)), room, "paper_id", by=by).select(*key, "score")


def scores_of(chunks: DataFrame, questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, paper_id, score: the best product of a question with a paper's chunks, for the pairs (query_id, paper_id)
    asked for. Null vectors have no score."""
    asked = pairs.select("query_id", "paper_id").distinct().join(questions.select("query_id", F.col("vec").alias("q")), "query_id")
    met = asked.join(chunks.select("paper_id", "vec"), "paper_id").where("vec IS NOT NULL AND q IS NOT NULL AND size(vec) = size(q)")
    return met.groupBy("query_id", "paper_id").agg(F.max(F.round(dot(F.col("vec"), F.col("q")), DIGITS)).alias("score"))


def neighbours(chunks: DataFrame, text: str = "text") -> DataFrame:
    """chunks (paper_id, section, ord, text) with before and after: the texts that stand next to each in its section."""
    w = W.partitionBy("paper_id", "section").orderBy("ord")
    near = lambda f, d: F.when(f("ord").over(w) == F.col("ord") + d, f(text).over(w))
    return chunks.withColumn("before", near(F.lag, -1)).withColumn("after", near(F.lead, 1))


def expanded(chunks: DataFrame, most: int = 4500) -> DataFrame:
    """context: the text with the one before it, then the one after it, as long as that is no longer than most."""
    first = F.when(F.col("before").isNotNull() & (F.length("before") + F.length("text") + 1 <= most), F.concat("before", F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    out = chunks.withColumn("context", first)
    return out.withColumn("context", F.when(F.col("after").isNotNull() & (F.length("context") + F.length("after") + 1 <= most), F.concat("context", F.lit("\n"), F.col("after"))).otherwise(F.col("context")))


def numbered_sources(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n (from 1, by first place), paper_id, chunks (in order) of hits (paper_id, chunk_id, pos); for each by where given."""
    by = by or []
    grouped = hits.groupBy(*by, "paper_id").agg(F.min("pos").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda s: s["chunk_id"]).alias("chunks"))
    order = W.partitionBy(*by).orderBy("first", "paper_id") if by else W.orderBy("first", "paper_id")
    return grouped.select(*by, F.row_number().over(order).cast("long").alias("n"), "paper_id", "chunks")
