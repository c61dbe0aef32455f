"""The registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import expr as E
from threadloom.operators import authors, nested, report, similarity, threads
from threadloom.plans import adapters as A
from threadloom.plans.workflow import RESULT_HINT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ACTIVE = 60
BUDGET = 4000.0
BINS = 50


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Views that several oracles share.
COMMENTS = """c AS (
    SELECT conv_id || '_' || turn AS id, role AS author, 't3_' || conv_id AS link_id, conv_id, turn, text AS body,
        CASE WHEN turn = 0 THEN 't3_' || conv_id ELSE 't1_' || conv_id || '_' || ((turn - 1) // 2) END AS parent_id,
        1420070400 + conv_id * 86400 + turn * 60 AS created_utc
    FROM conversations
)"""
UP = """up AS (
    SELECT c.link_id, c.id, p.id AS up FROM c JOIN c p ON p.link_id = c.link_id AND c.parent_id = 't1_' || p.id
)"""
USER = "assistant"
CLOSURE = f"""reach AS (
    SELECT link_id, id, id AS start FROM c WHERE author = '{USER}'
    UNION SELECT r.link_id, up.up, r.start FROM reach r JOIN up ON up.link_id = r.link_id AND up.id = r.id
), relevant AS (SELECT DISTINCT link_id, id FROM reach)"""


def _users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(USER,)], "user string")


@query("SELECT CAST(user_id AS VARCHAR) AS author, count(*) AS count FROM events GROUP BY 1")
def author_counts(spark, sf_dir):
    return authors.counts(A.activity(spark, sf_dir)).orderBy(F.desc("count"), "author")


@query(
    """SELECT source AS author, count(*) AS count, coalesce(sum(n_chars / 4.0::DOUBLE), 0) AS tokens FROM documents
    WHERE source NOT IN ('[deleted]', 'AutoModerator') AND NOT regexp_matches(source, '(?i)bot') GROUP BY 1"""
)
def author_tokens(spark, sf_dir):
    return authors.token_totals(A.authored(spark, sf_dir))


@query(
    f"""SELECT count(*) AS users, CAST(sum(count) AS BIGINT) AS rows FROM
    (SELECT user_id, count(*) AS count FROM events GROUP BY 1 HAVING count(*) >= {ACTIVE})"""
)
def active_authors(spark, sf_dir):
    active = authors.active(authors.counts(A.activity(spark, sf_dir)), ACTIVE)
    return active.agg(F.count("*").alias("users"), F.sum("count").alias("rows"))


@query(f"WITH {COMMENTS} SELECT id, strftime(make_timestamp(created_utc * 1000000), '%d-%m-%Y %H:%M') AS time FROM c")
def epoch_parse(spark, sf_dir):
    return A.comments(spark, sf_dir).select("id", E.epoch_text(F.col("created_utc").cast("string")).alias("time"))


_PREFIX = f"""p AS (SELECT * FROM (
    SELECT *, sum(n_chars / 4.0::DOUBLE) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running_tokens FROM documents
) WHERE running_tokens <= {BUDGET})"""


@query(f"WITH {_PREFIX} SELECT source AS author, doc_id AS id, running_tokens FROM p")
def token_budget_prefix(spark, sf_dir):
    return authors.budget_prefix(A.authored(spark, sf_dir), BUDGET, ["created_utc", "id"]).select("author", "id", "running_tokens")


@query(
    f"""WITH {_PREFIX} SELECT source AS author, string_agg('r/' || lang || ': ' || text, chr(10) ORDER BY doc_id) AS formatted_comment
    FROM p WHERE source NOT IN ('[deleted]', 'AutoModerator') AND NOT regexp_matches(source, '(?i)bot') GROUP BY 1"""
)
def author_text(spark, sf_dir):
    people = A.authored(spark, sf_dir).where(E.is_person(F.col("author")))
    held = authors.budget_prefix(people, BUDGET, ["created_utc", "id"])
    return authors.texts(held, E.community_line(F.col("subreddit"), F.col("body")), ["created_utc", "id"])


PART = 20000


@query(
    f"""WITH l AS (SELECT source AS author, doc_id, 'r/' || lang || ': ' || text AS line FROM documents WHERE source NOT IN ('[deleted]', 'AutoModerator') AND NOT regexp_matches(source, '(?i)bot')),
    m AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY author ORDER BY doc_id) - length(line) - 1 AS before FROM l WHERE line IS NOT NULL)
    SELECT author, CAST(before // {PART} AS INTEGER) AS part, md5(string_agg(line, chr(10) ORDER BY doc_id)) AS text_md5 FROM m GROUP BY 1, 2"""
)
def author_text_parts(spark, sf_dir):
    people = A.authored(spark, sf_dir).where(E.is_person(F.col("author")))
    parts = authors.text_parts(people, E.community_line(F.col("subreddit"), F.col("body")), ["created_utc", "id"], size=PART)
    return parts.select("author", "part", F.md5("formatted_comment").alias("text_md5"))


_BINNED = f"""n AS (SELECT CAST(user_id AS VARCHAR) AS author, count(*) AS v FROM events GROUP BY 1),
    x AS (SELECT min(v)::DOUBLE AS a, max(v)::DOUBLE AS b, count(*) AS total FROM n),
    y AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN 1.0::DOUBLE ELSE b - a END / {BINS} AS step, total FROM x),
    z AS (SELECT author, v, lo, step, total, CAST(least(floor((v - lo) / step), {BINS - 1}) AS INTEGER) AS bin FROM n, y)"""


@query(
    f"""WITH {_BINNED} SELECT bin, round(any_value(lo + bin * step), 6) AS low, round(any_value(lo + (bin + 1) * step), 6) AS high,
    count(*) AS freq, round(count(*) / any_value(total)::DOUBLE, 9) AS share FROM z GROUP BY bin"""
)
def count_histogram(spark, sf_dir):
    out = authors.histogram(authors.counts(A.activity(spark, sf_dir)), "count", BINS)
    return out.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "freq", F.round("share", 9).alias("share"))


@query(
    f"""WITH {_BINNED}, r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY v DESC, author) AS k, count(*) OVER (PARTITION BY bin) AS f FROM z)
    SELECT bin, any_value(f) AS freq, string_agg(author, ', ' ORDER BY k) || CASE WHEN any_value(f) > 10 THEN ', ...' ELSE '' END AS members
    FROM r WHERE k <= 10 GROUP BY bin"""
)
def histogram_top_members(spark, sf_dir):
    return authors.top_members(authors.counts(A.activity(spark, sf_dir)), BINS)


@query(
    f"""WITH {COMMENTS}, h AS (SELECT * FROM c ORDER BY created_utc, id LIMIT 1000)
    SELECT author FROM (SELECT author, min(created_utc || '|' || id) AS k, min(created_utc) AS t FROM h
        WHERE author IS NOT NULL AND author <> '' AND author <> '[deleted]' AND NOT ends_with(author, 'Bot') AND NOT ends_with(author, 'bot') GROUP BY 1)
    ORDER BY t, k LIMIT 2"""
)
def sample_users(spark, sf_dir):
    return authors.sample_targets(A.comments(spark, sf_dir), ["created_utc", "id"], 1000, 2)


@query("SELECT doc_id AS id, source AS author FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    return authors.seeded_sample(A.authored(spark, sf_dir), ["id"], 100, 7).select("id", "author")


@query(f"WITH {COMMENTS} SELECT DISTINCT author AS user, link_id FROM c WHERE author = '{USER}'")
def user_links(spark, sf_dir):
    return threads.user_links(A.comments(spark, sf_dir), _users(spark))


@query(
    f"""WITH {COMMENTS}, l AS (SELECT DISTINCT link_id FROM c WHERE author = '{USER}')
    SELECT link_id, count(*) AS comments FROM c WHERE link_id IN (SELECT link_id FROM l) GROUP BY 1"""
)
def linked_comments(spark, sf_dir):
    every = A.comments(spark, sf_dir)
    return threads.in_links(every, threads.user_links(every, _users(spark))).groupBy("link_id").agg(F.count("*").alias("comments"))


@query(
    f"""WITH {COMMENTS}, s AS (SELECT CAST(conv_id AS VARCHAR) AS id, 'sub' || (conv_id % 7) AS subreddit, substr(text, 1, 40) AS title
        FROM conversations WHERE turn = 0 AND conv_id % 10 <> 9)
    SELECT c.id, c.author, s.id AS submission_id, s.title AS submission_title, s.subreddit AS submission_subreddit
    FROM c LEFT JOIN s ON substr(c.link_id, 4) = s.id"""
)
def comments_with_submission(spark, sf_dir):
    joined = threads.with_submissions(A.comments(spark, sf_dir), A.submissions(spark, sf_dir))
    return joined.select("id", "author", "submission_id", "submission_title", "submission_subreddit")


@query(f"WITH RECURSIVE {COMMENTS}, {UP}, {CLOSURE} SELECT '{USER}' AS user, link_id, id FROM relevant r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = r.id AND c.author = '{USER}')")
def ancestors(spark, sf_dir):
    every = A.comments(spark, sf_dir)
    return threads.ancestors(every, threads.own_comments(every, _users(spark)), ["user"]).select("user", "link_id", "id")


@query(f"WITH RECURSIVE {COMMENTS}, {UP}, {CLOSURE} SELECT '{USER}' AS user, r.link_id, r.id, c.author = '{USER}' AS own FROM relevant r JOIN c USING (id)")
def relevant_set(spark, sf_dir):
    return threads.relevant(A.comments(spark, sf_dir), _users(spark)).select("user", "link_id", "id", "own")


@query(
    f"""WITH RECURSIVE {COMMENTS}, {UP}, d AS (
        SELECT link_id, id, 0 AS depth FROM c WHERE id NOT IN (SELECT id FROM up)
        UNION ALL SELECT up.link_id, up.id, depth + 1 FROM d JOIN up ON up.link_id = d.link_id AND up.up = d.id
    )
    SELECT c.link_id, c.id, up.up AS parent, depth, CAST(row_number() OVER (PARTITION BY c.link_id, up.up ORDER BY created_utc, c.id) - 1 AS INTEGER) AS place,
        CASE WHEN author = '{USER}' THEN 'SUBJECT' ELSE author END AS user
    FROM c LEFT JOIN up ON up.link_id = c.link_id AND up.id = c.id JOIN d ON d.link_id = c.link_id AND d.id = c.id"""
)
def thread_flat(spark, sf_dir):
    return threads.layout(A.comments(spark, sf_dir), F.lit(USER))


#: Escapes of JSON strings in ASCII, and the fields of a node at a depth; the same text as operators/nested.py makes.
_PIECES = r"[ !#-\[\]-~]+|(?s)."
_UNIT = "'\\u' || format('{{:04x}}', CAST({} AS INTEGER))"
_WIDE = f"{_UNIT.format('55296 + ((ord(x) - 65536) >> 10)')} || {_UNIT.format('56320 + ((ord(x) - 65536) & 1023)')}"


def _quoted(text: str) -> str:
    short = " ".join(f"WHEN x = chr({ord(c)}) THEN '{e}'" for c, e in nested.SHORT.items())
    each = f"CASE WHEN length(x) > 1 THEN x {short} WHEN ord(x) BETWEEN 32 AND 126 THEN x WHEN ord(x) >= 65536 THEN {_WIDE} ELSE {_UNIT.format('ord(x)')} END"
    return f"""coalesce('"' || array_to_string(list_transform(regexp_extract_all({text}, '{_PIECES}'), lambda x: {each}), '') || '"', 'null')"""


def _field(name: str, text: str) -> str:
    return f"""repeat('  ', 2 + 2 * depth) || '"{name}": ' || {_quoted(text)} || ',' || chr(10)"""


CONTEXTS = f"""{COMMENTS}, {UP}, {CLOSURE}, placed AS (
    SELECT c.*, up.up, row_number() OVER (PARTITION BY c.link_id, up.up ORDER BY created_utc, c.id) AS place
    FROM relevant r JOIN c USING (link_id, id) LEFT JOIN up ON up.link_id = c.link_id AND up.id = c.id
), labels AS (
    SELECT link_id, id, 1 AS depth, [place] AS label FROM placed WHERE up IS NULL
    UNION ALL SELECT p.link_id, p.id, depth + 1, list_append(label, place) FROM labels l JOIN placed p ON p.link_id = l.link_id AND p.up = l.id
), heads AS (
    SELECT 't3_' || conv_id AS link_id, conv_id, 'Title: ' || substr(text, 1, 40) || chr(10) || 'Subreddit: sub' || (conv_id % 7) || chr(10) || 'Body: ' AS body FROM conversations WHERE turn = 0 AND conv_id % 10 <> 9
), nodes AS (
    SELECT link_id, 0 AS depth, CAST([] AS BIGINT[]) AS label, 'system' AS who, 1420070400 + conv_id * 86400 AS made, body, CAST(NULL AS VARCHAR) AS own FROM heads
    UNION ALL SELECT p.link_id, depth, label, CASE WHEN author = '{USER}' THEN 'SUBJECT' ELSE author END, created_utc, p.body, CASE WHEN author = '{USER}' THEN p.id END
    FROM labels JOIN placed p USING (link_id, id) SEMI JOIN heads USING (link_id)
), following AS (
    SELECT *, strftime(make_timestamp(made * 1000000), '%d-%m-%Y %H:%M') AS time, lead(depth) OVER (PARTITION BY link_id ORDER BY label) AS nxt FROM nodes
), written AS (
    SELECT link_id, label, own, made, repeat('  ', 1 + 2 * depth) || '{{' || chr(10) || {_field("user", "who")} || {_field("time", "time")} || {_field("content", "body")}
        || repeat('  ', 2 + 2 * depth) || '"replies": [' || CASE WHEN nxt > depth THEN '' ELSE ']' || chr(10) || list_aggregate(list_transform(range(depth, coalesce(nxt, 0) - 1, -1), lambda d:
            CASE WHEN d = depth THEN '' ELSE repeat('  ', 2 + 2 * d) || ']' || chr(10) END || repeat('  ', 1 + 2 * d) || CASE WHEN d = nxt THEN '}},' ELSE '}}' END || chr(10)), 'string_agg', '') END
        || CASE WHEN nxt > depth THEN chr(10) ELSE '' END AS text
    FROM following
), contexts AS (
    SELECT '{USER}' AS user, substr(link_id, 4) AS submission_id, '[' || chr(10) || string_agg(text, '' ORDER BY label) || ']' AS formatted_context,
        string_agg(own, ',' ORDER BY made, own) FILTER (own IS NOT NULL) AS user_comment_ids
    FROM written GROUP BY link_id HAVING count(own) > 0
)"""


@query(f"WITH RECURSIVE {CONTEXTS} SELECT * FROM contexts")
def user_context(spark, sf_dir):
    built = threads.contexts(A.comments(spark, sf_dir), A.submissions(spark, sf_dir), _users(spark))
    return built.withColumn("user_comment_ids", F.array_join("user_comment_ids", ","))


@query(
    f"""WITH RECURSIVE {COMMENTS}, {UP}, {CLOSURE}
    SELECT '{USER}' AS user, substr(r.link_id, 4) AS submission_id, count(*) AS nodes, CAST(sum((c.author = '{USER}')::INT) AS BIGINT) AS own
    FROM relevant r JOIN c USING (id) WHERE c.conv_id % 10 <> 9 GROUP BY 2"""
)
def context_stats(spark, sf_dir):
    built = threads.contexts(A.comments(spark, sf_dir), A.submissions(spark, sf_dir), _users(spark))
    nodes = F.size(F.split("formatted_context", '"replies": ')) - 2
    return built.select("user", "submission_id", nodes.cast("long").alias("nodes"), F.size("user_comment_ids").cast("long").alias("own"))


_KNN = """q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM q),
    s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_inner_product(a.v, b.v), 6) AS similarity FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS INTEGER) AS place FROM s)"""


def _neighbours(spark, sf_dir, k):
    vectors = A.table(spark, sf_dir, "embeddings")
    return similarity.top_k(vectors.where("vec_id % 20 = 0"), vectors, k)


@query(f"WITH {_KNN} SELECT query, neighbour, similarity, place FROM k WHERE place <= 10")
def knn_topk(spark, sf_dir):
    return _neighbours(spark, sf_dir, 10)


@query(f"WITH {_KNN} SELECT query, string_agg(neighbour::VARCHAR, ',' ORDER BY place) AS neighbours FROM k WHERE place <= 5 GROUP BY 1")
def similarity_lists(spark, sf_dir):
    names = A.table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("author"))
    lists = similarity.neighbour_lists(_neighbours(spark, sf_dir, 5), names)
    return lists.select("query", F.array_join(F.transform("candidates", lambda c: c["name"]), ",").alias("neighbours"))


@query(
    """SELECT conv_id, turn, trim(regexp_extract_all('<result>draft</result> ' || '<result> ' || text || ' </result>', '(?s)<result>(.*?)</result>', 1)[-1], ' ' || chr(10) || chr(9) || chr(13)) AS result
    FROM conversations"""
)
def result_tag(spark, sf_dir):
    wrapped = F.concat(F.lit("<result>draft</result> <result> "), F.col("text"), F.lit(" </result>"))
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", E.result_tag(wrapped).alias("result"))


@query("SELECT k AS violation, count(*) AS count FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def json_keys_top(spark, sf_dir):
    return report.top_violations(A.activity(spark, sf_dir), "props")


_VERDICTS = """v AS (SELECT doc_id, lang AS model, CASE WHEN quality IS NULL THEN -1 ELSE 1 + doc_id % 3 END AS rank, quality = 1 AS correct,
    n_chars AS input_length, CASE WHEN quality IS NULL THEN -1 ELSE doc_id % 3 END AS violation_count FROM documents LEFT JOIN labels USING (doc_id))"""
_SCORES = """round(avg(CASE WHEN rank > 0 THEN rank END), 9) AS avg_rank, count(*) FILTER (rank > 0) AS n_ranked,
    round(100.0::DOUBLE * count(*) FILTER (correct) / nullif(count(correct), 0), 9) AS correct_pct, count(correct) AS n_judged"""


@query(
    f"""WITH {_VERDICTS} SELECT count(*) FILTER (violation_count >= 0) AS judged, CAST(coalesce(sum(violation_count) FILTER (violation_count > 0), 0) AS BIGINT) AS total,
    round(avg(violation_count) FILTER (violation_count >= 0), 9) AS average FROM v"""
)
def violation_summary(spark, sf_dir):
    return report.violation_summary(A.verdicts(spark, sf_dir)).withColumn("average", F.round("average", 9))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("avg_rank", "correct_pct")})


@query(f"WITH {_VERDICTS} SELECT model, {_SCORES} FROM v GROUP BY 1")
def leaderboard(spark, sf_dir):
    return _rounded(report.leaderboard(A.verdicts(spark, sf_dir)))


_TERCILES = """t AS (SELECT l[1 + CAST(round_even(0.333 * (len(l) - 1), 0) AS BIGINT)] AS q1, l[1 + CAST(round_even(0.667 * (len(l) - 1), 0) AS BIGINT)] AS q2,
    l[1] AS low, l[-1] AS high, CAST(len(l) AS BIGINT) AS n FROM (SELECT list(input_length ORDER BY input_length) AS l FROM v))"""


@query(f"WITH {_VERDICTS}, {_TERCILES} SELECT * FROM t")
def length_terciles(spark, sf_dir):
    return report.terciles(A.verdicts(spark, sf_dir), "input_length")


@query(
    f"""WITH {_VERDICTS}, {_TERCILES} SELECT CASE WHEN q1 <> q2 THEN CASE WHEN input_length <= q1 THEN 'Short' WHEN input_length <= q2 THEN 'Medium' ELSE 'Long' END
        ELSE CASE WHEN input_length < q1 THEN 'Short' WHEN input_length = q1 THEN 'Equal' ELSE 'Long' END END AS bucket, model, {_SCORES}
    FROM v, t GROUP BY 1, 2"""
)
def leaderboard_by_tercile(spark, sf_dir):
    return _rounded(report.leaderboard_by_tercile(A.verdicts(spark, sf_dir)))


@query(
    """WITH m AS (SELECT doc_id AS sample_id, unnest(['MODEL_A', 'MODEL_B', 'MODEL_C']) AS mask, unnest(['m0', 'm1', 'm2']) AS model FROM documents),
    r AS (SELECT doc_id AS sample_id, unnest(['MODEL_' || chr(65 + (doc_id % 3)::INT), 'MODEL_X', 'MODEL_' || chr(65 + ((doc_id + 1) % 3)::INT)]) AS mask, unnest([0, 1, 2]) AS spot FROM documents),
    k AS (SELECT sample_id, model, row_number() OVER (PARTITION BY sample_id ORDER BY spot) AS rank FROM r JOIN m USING (sample_id, mask))
    SELECT m.sample_id, m.model, CAST(coalesce(rank, -1) AS INTEGER) AS rank FROM m LEFT JOIN k USING (sample_id, model)"""
)
def judge_unmask(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"))
    mask = lambda n: F.concat(F.lit("MODEL_"), F.char((65 + (F.col("sample_id") + n) % 3).cast("int")))
    rankings = docs.select("sample_id", F.array(mask(0), F.lit("MODEL_X"), mask(1)).alias("ranking"))
    pairs = F.array(*(F.struct(F.lit(f"MODEL_{'ABC'[i]}").alias("mask"), F.lit(f"m{i}").alias("model")) for i in range(3)))
    return report.unmask(rankings, docs.select("sample_id", F.inline(pairs)))


@query(
    """SELECT c_name AS name, CAST(c_nationkey AS BIGINT) AS nationkey, c_acctbal AS acctbal FROM customer
    UNION ALL SELECT s_name, CAST(s_nationkey AS BIGINT), s_acctbal FROM supplier"""
)
def union_relaxed(spark, sf_dir):
    shape = lambda df, p, kind: df.select(F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").cast(kind).alias("nationkey"), F.col(f"{p}_acctbal").alias("acctbal"))
    return authors.union_relaxed(shape(A.table(spark, sf_dir, "customer"), "c", "long"), shape(A.table(spark, sf_dir, "supplier"), "s", "int"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_first(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return authors.keep_first(docs, ["text_md5"], ["doc_id"])


@query(
    r"""WITH r AS (SELECT length(text) / (n_chars / 4.0::DOUBLE) AS c, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) / (n_chars / 4.0::DOUBLE) AS w FROM documents WHERE n_chars > 0)
    SELECT round(avg(c), 6) AS mean_chars, round(median(c), 6) AS median_chars, round(avg(w), 6) AS mean_words, round(median(w), 6) AS median_words FROM r"""
)
def token_ratios(spark, sf_dir):
    out = authors.token_ratios(A.table(spark, sf_dir, "documents"), "text", F.col("n_chars") / 4)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("SELECT 'quality' AS column, count(quality) AS present, count(quality) = 0 AS all_null FROM labels UNION ALL SELECT 'toxic', count(toxic), count(toxic) = 0 FROM labels")
def null_audit(spark, sf_dir):
    return report.null_audit(A.table(spark, sf_dir, "labels"), "quality", "toxic")


STUB_PROMPTS = {"inference": ("Infer.", "v1"), "intent_only": ("Intents.", "v1"), "koa_only": ("Knowledge.", "v1"), "all_in_one": ("All.", "v1")}


def stub_answer(model: str, text: str) -> str:
    """Answers of a stand-in model: outputs of tasks, verdicts for judges; every seventh length fails."""
    if "OUTPUTS:" in text:
        return '<result>{"ranking": ["MODEL_B", "MODEL_A"], "rationale": "MODEL_B reads better", "correct_models": ["MODEL_B"]}</result>'
    if len(text) % 7 == 0:
        raise ValueError("refused")
    if text.startswith("Infer."):
        return f'<result>{{"inference_output": "{len(text)}"}}</result>'
    return f'thinking <result>{{"intents": ["{model}"], "koa": ["{len(text)}",]}}</result>'


def _prompted(prompt: str, data: str) -> str:
    """Length of a task's prompt with its input data, in SQL."""
    head, tail = (len(t) for t in (f"{prompt}\n\nINPUT DATA:\n---\n", "\n---" + RESULT_HINT))
    return f"{head + tail} + length({data})"


@query(
    f"""WITH RECURSIVE {CONTEXTS}, first AS (
        SELECT CAST(submission_id AS BIGINT) AS sample_id, formatted_context AS t, {_prompted("Infer.", "formatted_context")} AS n FROM contexts
    ), second AS (
        SELECT sample_id, n % 7 <> 0 AND ({_prompted("Intents.", "t || chr(10) || chr(10) || 'INFERENCE:' || chr(10) || json_object('inference_output', CAST(n AS VARCHAR))")} + 1) % 7 <> 0 AS valid FROM first
    ), masked AS (
        SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY md5('7|' || sample_id || '|' || model)) = 2 AS b FROM (SELECT *, unnest(['m1', 'm2']) AS model FROM second)
    )
    SELECT sample_id, model, CASE WHEN NOT valid THEN -1 WHEN b THEN 1 ELSE 2 END AS rank, CASE WHEN valid THEN b END AS correct,
        CASE WHEN NOT valid THEN 'Not Judged (Input Error)' END AS judge_status
    FROM masked"""
)
def workflow_stub(spark, sf_dir):
    """All conversations' contexts through a two-stage workflow of two models and a ranking judge, with a stub client."""
    from threadloom.plans import judging, workflow
    from threadloom.sources.clients import StubClient

    built = threads.contexts(A.comments(spark, sf_dir), A.submissions(spark, sf_dir), _users(spark))
    samples = built.select(F.col("submission_id").cast("long").alias("sample_id"), "formatted_context")
    catalogue = workflow.Catalogue(STUB_PROMPTS, formatters=workflow.FORMATTERS)
    stages, client = workflow.WORKFLOWS["inference_with_intent"], StubClient(stub_answer)
    results = workflow.run_workflow(samples, ["m1", "m2"], stages, catalogue, client)
    inputs = workflow.judge_inputs(results, stages)
    return judging.judge_rankings(samples, inputs, client, "judge", "Rank by the intents.", 7).select("sample_id", "model", "rank", "correct", "judge_status")


@query("SELECT date_trunc('hour', ts) AS start, CAST(user_id AS VARCHAR) AS author, count(*) AS count FROM events GROUP BY 1, 2")
def hourly_activity(spark, sf_dir):
    from threadloom.streaming.activity import windowed_counts

    return windowed_counts(A.activity(spark, sf_dir))
