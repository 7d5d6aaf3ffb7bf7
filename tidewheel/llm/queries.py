"""Queries p1 to p9 over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import copies, lookalike, mixing, mojibake, readability, residue, seen, survivor, tokens
from tidewheel.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _titles(spark: SparkSession, d: str, *names: str, column: str = "title") -> list[DataFrame]:
    return [table(spark, d, n).select(F.lit(n).alias("table_name"), "seq", F.col(column).alias("text")) for n in names]


def _garble_tokens(spark: SparkSession, frames: list[DataFrame]):
    """Corpus tokens of all rows, broadcast; their number is bounded by ``min_share`` (see ``corpus_tokens``)."""
    return spark.sparkContext.broadcast(mojibake.corpus_tokens([F.col("text")] * len(frames), frames))


def _titles_and_names(spark: SparkSession, d: str):
    """Titles and names, and what is learned of both: the tokens of garbled titles, the words of confusable letters."""
    (titles,) = _titles(spark, d, "page_content")
    (names,) = _titles(spark, d, "user_records", column="name")
    return titles, names, _garble_tokens(spark, [titles]), spark.sparkContext.broadcast(lookalike.word_shapes([titles, names]))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    titles, names, shared, shapes = _titles_and_names(spark, d)
    keys = ["table_name", "seq"]
    found = [
        lookalike.unify_suspects(df.select(*keys, F.col("text").alias("_text")).where(F.col("_text").isNotNull()), keys, tokens, only_changed=True, shapes=shapes)
        for df, tokens in ((titles, shared), (names, None))
    ]
    return found[0].unionByName(found[1]).select(*keys)


@query
def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every title and name in its consistent form."""
    titles, names, shared, shapes = _titles_and_names(spark, d)
    keys = ["table_name", "seq"]
    return lookalike.unify(titles, "text", keys, shared, shapes).unionByName(lookalike.unify(names, "text", keys, shapes=shapes))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.best_rows(table(spark, d, "user_groups"), table(spark, d, "user_records"), table(spark, d, "source_trust"))


@query
def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group, with where each field comes from."""
    return survivor.best_fields(table(spark, d, "user_groups"), table(spark, d, "user_records"), table(spark, d, "source_trust"))


def _judged(spark: SparkSession, d: str, found: bool) -> DataFrame:
    pages, data = _titles(spark, d, "page_content", "page_data")
    return residue.mark_residue(pages.unionByName(data), ["table_name", "seq"], _garble_tokens(spark, [pages, data]), found)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, True)


@query
def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """The rows with real titles, or none: what is left without those of ``p3_found``."""
    return _judged(spark, d, False)


PAGE_KEY = {"url": copies.bare_address}
USER_KEY = {"id": lambda c: c, "name": copies.bare_name, "email": copies.bare, "source_url": copies.bare_address}


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pages = copies.copies_of_first(table(spark, d, "page_content").where(F.col("url").isNotNull()), PAGE_KEY)
    users = copies.copies_of_first(table(spark, d, "user_records"), USER_KEY)
    named = [df.select(F.lit(n).alias("table_name"), "first_seq", "seq") for n, df in (("page_content", pages), ("user_records", users))]
    return named[0].unionByName(named[1])


@query
def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per page or record, with the number of its copies; pages without a url each stand alone."""
    pages = table(spark, d, "page_content")
    _, of_pages = copies.collapse(pages.where(F.col("url").isNotNull()), PAGE_KEY)
    _, of_users = copies.collapse(table(spark, d, "user_records"), USER_KEY)
    alone = pages.where(F.col("url").isNull()).select(F.lit("page_content").alias("table_name"), F.col("seq").alias("first_seq"), F.lit(1).cast("long").alias("copies"))
    named = [df.select(F.lit(n).alias("table_name"), "first_seq", "copies") for n, df in (("page_content", of_pages), ("user_records", of_users))]
    return named[0].unionByName(named[1]).unionByName(alone)


def _keys(spark: SparkSession, d: str) -> tuple[list[DataFrame], DataFrame]:
    key = lambda n, c="url": table(spark, d, n).select("seq", F.col(c).alias("key"))
    return [key("crawl_seeds", "uri"), key("page_content")], key("page_data")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows of which the filters say that their key was seen; wrong ones are to be expected at their rate."""
    return seen.answers(*_keys(spark, d)).where("maybe").select("seq")


@query
def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the filters, wrong ones among them by an exact check, and the rate measured with keys known to be absent."""
    return seen.rates(*_keys(spark, d))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_restored(spark, d).select("table_name", "seq")


@query
def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    """Each garbled title with what could be restored; ``whole`` tells whether nothing was lost."""
    pages, data = _titles(spark, d, "page_content", "page_data")
    shared = _garble_tokens(spark, [pages, data])
    return mojibake.mark_garbled(pages.unionByName(data), "text", ["table_name", "seq"], shared)


@query
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "text", ["doc_id"])


def _mix_plan(spark: SparkSession, d: str, weighted: bool = False) -> tuple[DataFrame, list[dict]]:
    targets = table(spark, d, "mix_targets")
    documents = table(spark, d, "documents").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    counted = tokens.count_tokens(documents, "text", ["doc_id", "source"])
    weight = F.sqrt(F.col("n_tokens")) if weighted else F.lit(1.0)
    sizes = mixing.sized(counted.withColumn("weight", weight), targets)
    return sizes, mixing.allot(sizes, targets)


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeats; all documents of a source have the same odds."""
    return mixing.mix(*_mix_plan(spark, d))


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    sizes, plan = _mix_plan(spark, d)
    return mixing.shares(mixing.mix(sizes, plan), plan)


@query
def p8_weighted(spark: SparkSession, d: str) -> DataFrame:
    """As p8_mix, with odds that rise with the square root of a document's tokens."""
    return mixing.mix(*_mix_plan(spark, d, weighted=True))


@query
def p8_inclusion(spark: SparkSession, d: str) -> DataFrame:
    """Copies of p8_weighted by source and weight, beside those that the weights ask for."""
    sizes, plan = _mix_plan(spark, d, weighted=True)
    return mixing.inclusion(sizes, plan, mixing.mix(sizes, plan))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return readability.read_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def _sql_bare(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[\s\x85\p{{Z}}\p{{P}}$+<=>^`|~]+', '', 'g')"


def _sql_address(c: str) -> str:
    fields = f"list_transform(string_split_regex(regexp_extract({c}, '(?s)^[^?]*\\?(.*)$', 1), '[&;#]'), lambda f: {_sql_bare("split_part(f, '=', 1)")} || chr(30) || {_sql_bare("substr(f, length(split_part(f, '=', 1)) + 2)")})"
    return f"{_sql_bare(f"split_part({c}, '?', 1)")} || chr(29) || array_to_string(list_sort(list_filter({fields}, lambda f: f <> chr(30))), chr(31))"


_SQL_NAME = r"array_to_string(list_sort(list_filter(list_transform(string_split_regex(lower(name), '(?:[\s\x85\p{Z}\p{Pd}\p{Ps}\p{Pe}\p{Pc}$+<=>^`|~!-&*-/:;?@\\¡§¶·¿…、。])+'), lambda p: regexp_replace(p, '\p{P}', '', 'g')), lambda p: p <> '')), ' ')"

_SQL_KEYS = f"""WITH keyed AS (
    SELECT 'page_content' AS table_name, seq, NULL::BIGINT AS id, {_sql_address("url")} AS a, NULL AS b, NULL AS c FROM page_content WHERE url IS NOT NULL
    UNION ALL
    SELECT 'user_records', seq, id, {_SQL_NAME}, {_sql_bare("email")}, {_sql_address("source_url")} FROM user_records
)"""

ORACLES["p4_found"] = f"""{_SQL_KEYS}, firsts AS (SELECT table_name, seq, min(seq) OVER (PARTITION BY table_name, id, a, b, c) AS first_seq FROM keyed)
SELECT table_name, first_seq, seq FROM firsts WHERE seq <> first_seq"""

ORACLES["p4_records"] = f"""{_SQL_KEYS}
SELECT table_name, min(seq) AS first_seq, count(*) AS copies FROM keyed GROUP BY table_name, id, a, b, c
UNION ALL SELECT 'page_content', seq, 1 FROM page_content WHERE url IS NULL"""

ORACLES["p6_found"] = """WITH keys AS (
    SELECT 0 AS rank, seq, uri AS key FROM crawl_seeds UNION ALL SELECT 1, seq, url FROM page_content UNION ALL SELECT 2, seq, url FROM page_data
), numbered AS (SELECT rank, seq, row_number() OVER (PARTITION BY key ORDER BY rank, seq) AS n FROM keys WHERE key IS NOT NULL)
SELECT seq FROM numbered WHERE rank = 2 AND n > 1"""

_SQL_SURVIVORS = r"""WITH trusted AS (SELECT lower(trim(host)) AS host, max(trust) AS trust FROM source_trust GROUP BY 1),
rows AS (
    SELECT g.group_id, r.seq, r.email, r.source_url, CASE WHEN r.processed_at >= TIMESTAMP '2024-01-01' AND r.processed_at < TIMESTAMP '2026-01-01' THEN r.processed_at END AS t,
        lower(regexp_extract(regexp_replace(r.source_url, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '(?is)^https?://(?:[^/?#@\s]*@)?([\p{L}\p{N}](?:[\p{L}\p{N}.-]*[\p{L}\p{N}])?)\.?(?::\d+)?(?:[/?#].*)?$', 1)) AS host,
        lower(regexp_replace(r.email, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS mail
    FROM user_groups g JOIN user_records r USING (seq)
), judged AS (
    SELECT rows.*, CASE WHEN coalesce(rows.host, '') <> '' THEN coalesce(trusted.trust, 0) ELSE 0 END AS level,
        regexp_matches(mail, '^[^\s@,;:<>()\[\]"*…?#/\\]+@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?)+$') AND NOT regexp_matches(mail, '\.\.|^\.|\.@|^xx+@|@xx+\.')
        AND split_part(mail, '@', 1) NOT IN ('none', 'null', 'nan', 'na', 'unknown', 'hidden', 'redacted', 'noemail', 'noreply', 'example', 'invalid', 'xxx', 'xxxx', 'test') AS mail_ok
    FROM rows LEFT JOIN trusted USING (host)
), e AS (SELECT group_id, seq, email FROM judged WHERE mail_ok QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY level DESC, t DESC NULLS LAST, seq) = 1),
u AS (SELECT group_id, seq, source_url FROM judged WHERE coalesce(host, '') <> '' QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY level DESC, t DESC NULLS LAST, seq) = 1),
p AS (SELECT group_id, seq, t FROM judged WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY t DESC, seq) = 1),
g AS (SELECT DISTINCT group_id FROM user_groups)
"""
ORACLES["p2_found"] = _SQL_SURVIVORS + "SELECT g.group_id, e.seq AS email_seq, p.seq AS time_seq, u.seq AS url_seq FROM g LEFT JOIN e USING (group_id) LEFT JOIN p USING (group_id) LEFT JOIN u USING (group_id)"
ORACLES["p2_survivors"] = _SQL_SURVIVORS + "SELECT g.group_id, e.seq AS email_seq, p.seq AS time_seq, u.seq AS url_seq, e.email, p.t AS processed_at, u.source_url FROM g LEFT JOIN e USING (group_id) LEFT JOIN p USING (group_id) LEFT JOIN u USING (group_id)"
