"""Ranking and text retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_set(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([\\p{L}\\p{N}]+)"), 1))


def overlap_score(text: Column, query: Column) -> Column:
    """12 for each shared word of more than three characters, 4 for each shorter one."""
    shared = F.array_intersect(word_set(text), word_set(query))
    return F.aggregate(shared, F.lit(0), lambda s, w: s + F.when(F.length(w) > 3, 12).otherwise(4))


def rank_candidates(rows: DataFrame, query: str, id: str, text: str, exact: Column, path_hits: Column, exact_bonus: int = 10_000, path_bonus: int = 5000) -> DataFrame:
    """Rows with a score of overlap, exact match and path hits, those above 0, by score and id."""
    score = overlap_score(F.col(text), F.lit(query)) + F.when(exact, exact_bonus).otherwise(0) + F.when(path_hits > 0, path_bonus + path_hits).otherwise(0)
    return rows.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), id)


def occurrences(text: Column, term: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def literal_retrieval(rows: DataFrame, terms: list[str], id: str, path: str, text: str, limit: int) -> DataFrame:
    """20 for each term in the path and up to 10 for its occurrences in the text; those above 0, by score and path."""
    low, where = F.lower(F.col(text)), F.lower(F.col(path))
    score = F.lit(0)
    for t in (x.lower() for x in terms):
        score = score + F.when(where.contains(t), 20).otherwise(0) + F.least(occurrences(low, t), F.lit(10))
    return rows.select(id, path, score.alias("score")).where("score > 0").orderBy(F.desc("score"), path, id).limit(limit)


def concept_index(subjects: DataFrame, concepts: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """``(concept, id, reasons)``: dictionary terms found among the words of each field; an alias of several concepts says nothing."""
    telling = concepts.groupBy("term").agg(F.min("concept").alias("concept"), F.count_distinct("concept").alias("n")).where("n = 1").drop("n")
    each = F.explode(F.flatten(F.array(*[F.transform(word_set(F.col(f)), lambda w, f=f: F.struct(F.lit(f).alias("field"), w.alias("term"))) for f in fields])))
    return subjects.select(id, each.alias("m")).select(id, "m.field", "m.term").join(telling, "term").groupBy("concept", id).agg(F.count_distinct("field", "term").alias("reasons"))


def token_estimate(columns: list[str]) -> Column:
    """A quarter of the JSON's length, rounded up."""
    return F.ceil(F.length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})) / 4).cast("long")


def singular(word: Column) -> Column:
    low = F.lower(word)
    return F.when(low.endswith("ies"), F.concat(F.regexp_replace(word, "(?i)ies$", ""), F.lit("y"))).when(low.rlike("ss$|us$") | ~low.endswith("s"), word).otherwise(F.regexp_replace(word, "(?i)s$", ""))


def title_case(text: Column) -> Column:
    """Words between white space, underscores and hyphens with one capital each."""
    words = F.filter(F.split(text, r"[\s_-]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), " ")


def route_parts(route: Column) -> Column:
    """Segments of a route without parameters, ``api`` and version numbers."""
    return F.filter(F.split(F.regexp_replace(route, r"\?.*$", ""), "/"), lambda p: (p != "") & ~p.startswith(":") & ~p.rlike(r"^\[.*\]$") & ~p.rlike(r"(?i)^(api|v[0-9]+)$"))


#: Last segments that name an action, with a whole title or a verb for what stands before.
TITLES = {"login": "Sign In", "logout": "Sign Out", "accept-invite": "Accept Invite", "invite-lookup": "Look Up Invite", "remind": "Send Reminder"}
ACTIONS = {"redeem": "Redeem", "approve": "Approve", "reject": "Reject", "undo": "Undo", "settle": "Settle", "exit": "Exit", "verify": "Verify"}


def route_title(method: Column, route: Column) -> Column:
    """A name for an endpoint, by action, health check, or method and last segment; null for wildcards and where no segment tells."""
    parts = route_parts(route)
    last, before = F.element_at(parts, -1), F.get(parts, F.size(parts) - 2)
    low, reads = F.lower(last), method.isin("GET", "HEAD")
    by_id = F.exists(F.split(F.regexp_replace(route, r"\?.*$", ""), "/"), lambda p: p.startswith(":") | p.rlike(r"^\[.*\]$"))
    one, many = title_case(singular(last)), title_case(last)
    title = F.when(reads & (low == "me"), "Get Current User")
    for word, text in TITLES.items():
        title = title.when(low == word, text)
    for word, verb in ACTIONS.items():
        title = title.when(low == word, F.concat_ws(" ", F.lit(verb), title_case(singular(before))))
    title = title.when(reads & low.isin("health", "healthz", "ready", "readiness", "live", "liveness", "ping", "status"), F.concat(F.lit("Check "), many))
    title = title.when(reads & by_id, F.concat(F.lit("Get "), one)).when(reads, F.concat(F.lit("List "), many))
    for methods, verb in ((("POST",), "Create"), (("PUT", "PATCH"), "Update"), (("DELETE",), "Delete")):
        title = title.when(method.isin(*methods), F.concat(F.lit(verb + " "), one))
    return F.when((F.size(parts) > 0) & ~route.rlike(r"[*()]|\$\{"), title.otherwise(F.concat(F.lit("Handle "), method, F.lit(" "), many)))


def confidence(exact_handler: Column, exact_entry: Column, coverage: Column, boundary: Column, sibling: Column, truncated: Column) -> Column:
    """``(score, level)`` of a name from its evidence: between 0 and 1, high from 0.85, medium from 0.7."""
    add = lambda c, x: F.when(c, x).otherwise(0.0)
    raw = F.lit(0.6) + F.when(exact_handler, 0.15).otherwise(add(exact_entry, 0.05) - 0.2) + coverage * 0.15 + add(boundary, 0.1) - add(sibling, 0.25) - add(truncated, 0.15) - add(coverage == 0, 0.1)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 2)
    return F.struct(score.alias("score"), F.when(score >= 0.85, "high").when(score >= 0.7, "medium").otherwise("low").alias("level"))


def shared_depth(a: Column, b: Column) -> Column:
    """Leading folders that two paths share."""
    x, y = (F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1) for p in (a, b))
    same = F.zip_with(x, y, lambda u, v: F.coalesce(u == v, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, e: F.struct(F.when(s["go"] & e, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["go"] & e).alias("go")), lambda s: s["n"])


def longest_ordered_match(rows: DataFrame, id: str, expected: str, actual: str) -> DataFrame:
    """``(id, expected_n, matched)``: the length of the longest common subsequence of two arrays, by Arrow batches."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, m = [], []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                row = [0] * (len(b or ()) + 1)
                for x in a or ():
                    last = 0
                    for j, y in enumerate(b or (), 1):
                        keep = row[j]
                        row[j] = last + 1 if x == y else max(row[j], row[j - 1])
                        last = keep
                n.append(len(a or ()))
                m.append(row[-1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=["id", "expected_n", "matched"])

    kind = rows.schema[id].dataType.simpleString()
    return rows.select(F.col(id).alias("id"), F.col(expected).alias("a"), F.col(actual).alias("b")).mapInArrow(run, f"id {kind}, expected_n long, matched long").withColumnRenamed("id", id)
