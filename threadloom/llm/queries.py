"""Queries of this subpackage: one thin opN_<name> for each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import read
from threadloom.llm.decontaminate import find_contamination
from threadloom.llm.langid import identify
from threadloom.llm.licenses import scan_licenses
from threadloom.llm.merkle import edited_fingerprints
from threadloom.llm.pieces import round_trips
from threadloom.llm.secrets import find_secrets
from threadloom.llm.sharding import ROUNDS, round_keys, shard_documents
from threadloom.llm.simhash import near_duplicates
from threadloom.llm.suffixes import remove_repeats
from threadloom.llm.tries import rebuilt_trie
from threadloom.llm.urlfilter import judge_urls
from threadloom.llm.warc import read_warc, write_warc
from threadloom.llm.whitening import by_component, whiten


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_warc(write_warc(read(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), 24, SEED)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"))
    named = F.transform("matches", lambda m: F.concat_ws(":", m["name"], m["start"], m["end"], F.round(m["coverage"], 3)))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(named, ",").alias("matches"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("starts", "ends")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(whiten(read(spark, sf_dir, "embeddings")))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_sharding": op2_sharding,
    "op3_secrets": op3_secrets,
    "op4_pieces": op4_pieces,
    "op5_decontamination": op5_decontamination,
    "op6_licenses": op6_licenses,
    "op7_suffixes": op7_suffixes,
    "op8_simhash": op8_simhash,
    "op9_merkle": op9_merkle,
    "op10_language": op10_language,
    "op11_whitening": op11_whitening,
    "op12_urls": op12_urls,
    "op13_prefixes": op13_prefixes,
}
SEED = 20240601
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

ORACLES: dict[str, str] = {
    "op2_sharding": f"""
        WITH RECURSIVE t AS (
            SELECT list(c ORDER BY i) AS tbl FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
            )
        ), d AS (
            SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS rn FROM documents
        ), p AS (
            SELECT doc_id, rn, CAST(octet_length(encode(text)) AS BIGINT) AS bytes,
                flatten(list_transform(list_transform(regexp_extract_all(text, '(?s).'), lambda x: CAST(ord(x) AS BIGINT)), lambda u:
                    CASE WHEN u < 128 THEN [u] WHEN u < 2048 THEN [192 | (u >> 6), 128 | (u & 63)]
                    WHEN u < 65536 THEN [224 | (u >> 12), 128 | ((u >> 6) & 63), 128 | (u & 63)]
                    ELSE [240 | (u >> 18), 128 | ((u >> 12) & 63), 128 | ((u >> 6) & 63), 128 | (u & 63)] END)) AS b
            FROM d
        ), crc AS (
            SELECT doc_id, rn, bytes, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tbl[1 + (xor(c, x) & 255)])), 4294967295) AS crc FROM p, t
        ), n AS (
            SELECT count(*) AS total, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS side FROM documents
        ), walk AS (
            SELECT rn, rn // side AS l, rn % side AS r, 0 AS k, total, side FROM d, n
            UNION ALL
            SELECT rn, r AS l, (l + xor(h, h >> 13) % side) % side AS r, k + 1 AS k, total, side FROM (
                SELECT *, (xor(g, g >> 15) * 668265261) & 2147483647 AS h FROM (
                    SELECT *, (((r + {round_keys(SEED)}[1 + k % {ROUNDS}]) & 2147483647) * 73244475) & 2147483647 AS g FROM walk
                    WHERE NOT (k > 0 AND k % {ROUNDS} = 0 AND l * side + r < total)
                )
            )
        ), spots AS (
            SELECT rn, l * side + r AS spot FROM walk WHERE k > 0 AND k % {ROUNDS} = 0 AND l * side + r < total
        )
        SELECT doc_id, bytes + 8 AS size, crc AS text_crc32, 'rows' AS law, CAST(spot % 24 AS INTEGER) AS shard, spot // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM crc JOIN spots USING (rn)
    """,
    "op1_warc": """
        WITH p AS (
            SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages
        ), h AS (
            SELECT page_id, url, octet_length(payload) AS n, sha1(payload) AS sha FROM p
        ), r AS (
            SELECT *, row_number() OVER w AS k, max(page_id) OVER (PARTITION BY sha, n) AS best
            FROM h WINDOW w AS (PARTITION BY sha, n ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST)
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((CAST('0x' || substr(sha, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN k = 1 THEN NULL ELSE best END AS refers_to
        FROM r
    """,
    "op5_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), i AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), win AS (
            SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s : s + 12], ' ') AS k
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)
        ), lens AS (
            SELECT DISTINCT n FROM win
        ), occ AS (
            SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS k
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)
        ), hit AS (
            SELECT doc_id, s, occ.n, item FROM occ JOIN win ON occ.n = win.n AND occ.k = win.k
        ), covered AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op9_merkle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
        ), o AS (
            SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nx
            FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, sha256(text) DESC)
        ), e AS (
            SELECT *, row_number() OVER () AS rid, substr(text, 1, n - n // 2) || substr(nx, 1, n // 2) AS edited FROM o
        ), t AS (
            SELECT unnest([text, edited, nx]) AS x, unnest([0, 1, 2]) AS role, rid, doc_id, n, sha256(edited) AS edited_sha256 FROM e
        ), l AS (
            SELECT rid, doc_id, n, edited_sha256, role, list_transform(flatten(list_transform(regexp_extract_all(x, '(?s)(?:.*?(?:\n|[.!?] )|.+$)'), lambda q: regexp_extract_all(q, '(?s).{1,32}'))), lambda p: sha256(p)) AS leaves FROM t
        ), m AS (
            SELECT *, coalesce(list_aggregate(list_transform(leaves, lambda h: CASE WHEN h[8] IN ('0', '8') THEN h || chr(31) ELSE h END), 'string_agg', '.'), '') AS marked FROM l
        ), s AS (
            SELECT *, list_transform(list_filter(string_split_regex(marked, chr(31) || '\.?'), lambda g: g <> ''), lambda g: sha256(g)) AS sections,
                list_transform(leaves, lambda h: h[1:8]) AS short
            FROM m
        ), r AS (
            SELECT *, sha256(coalesce(list_aggregate(sections, 'string_agg', '.'), ''))[1:32] AS root FROM s
        ), f AS (
            SELECT rid, doc_id, n, edited_sha256, role, short, root,
                root || ':' || coalesce(list_aggregate(list_transform(sections, lambda h: h[1:16]), 'string_agg', '.'), '') || ':' || coalesce(list_aggregate(short, 'string_agg', '.'), '') AS print
            FROM r
        ), k AS (
            SELECT *, row_number() OVER (PARTITION BY rid, role, h ORDER BY i) AS nth
            FROM (SELECT rid, role, unnest(short) AS h, generate_subscripts(short, 1) AS i FROM f)
        ), j AS (
            SELECT a.rid, b.role, list([b.i] ORDER BY a.i) AS js FROM k a JOIN k b ON a.rid = b.rid AND a.h = b.h AND a.nth = b.nth
            WHERE a.role = 0 AND b.role > 0 GROUP BY a.rid, b.role
        ), v AS (
            SELECT rid, role, len(list_reduce(js, lambda t, x: CASE WHEN x[1] > t[-1] THEN list_append(t, x[1])
                ELSE list_transform(t, lambda y, m: CASE WHEN y > x[1] AND (m = 1 OR t[m - 1] < x[1]) THEN x[1] ELSE y END) END)) AS aligned
            FROM j
        ), c AS (
            SELECT a.rid, b.role, b.print, CASE WHEN a.root = b.root THEN 1.0::DOUBLE
                    ELSE least(2.0::DOUBLE * coalesce(aligned, 0), len(a.short) + len(b.short) - 1.0::DOUBLE) / (len(a.short) + len(b.short)) END AS near,
                nullif(list_position(list_transform(list_zip(a.short, b.short), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false), 0) - 1 AS first_edit
            FROM f a JOIN f b ON a.rid = b.rid LEFT JOIN v ON v.rid = b.rid AND v.role = b.role WHERE a.role = 0 AND b.role > 0
        )
        SELECT f.doc_id, CAST(f.n AS BIGINT) AS n_chars, f.edited_sha256, f.print AS fingerprint, e.print AS edited_fingerprint,
            e.near AS near_edited, x.near AS near_next, CAST(e.first_edit AS BIGINT) AS first_edit
        FROM f JOIN c e ON e.rid = f.rid AND e.role = 1 JOIN c x ON x.rid = f.rid AND x.role = 2 WHERE f.role = 0
    """,
    "op12_urls": f"""
        WITH u AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id, row_number() OVER () AS place, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM u
        ), r AS (
            SELECT * FROM (VALUES {", ".join(map(str, URL_RULES))}) v(h, p, verdict)
        ), b AS (
            SELECT place, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
            FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY place
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (place)
    """,
    "op13_prefixes": r"""
        WITH tbl AS (
            SELECT list(c ORDER BY i) AS tbl FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
            )
        ), t AS (
            SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS turn_key
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(turn_key)) - 1 AS place FROM t
        ), convs AS (
            SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(CAST(conv_id AS VARCHAR), '.'),
                lambda x: CAST(ord(x) AS BIGINT))), lambda c, x: xor(c >> 8, tbl[1 + (xor(c, x) & 255)])), 4294967295) % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM t), tbl
        ), both_ AS (
            SELECT c.conv_id, place, turn_key, text FROM convs c JOIN own ON own.conv_id = c.base WHERE place < h
            UNION ALL SELECT conv_id, place, turn_key, text FROM convs JOIN own USING (conv_id) WHERE place >= h
        ), seq AS (
            SELECT conv_id, row_number() OVER w AS depth, list(turn_key) OVER w AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
            FROM both_ WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
        ), steps AS (
            SELECT conv_id, 0 AS depth, CAST([] AS VARCHAR[]) AS path, 0 AS words FROM convs UNION ALL SELECT * FROM seq
        ), ends AS (
            SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
            FROM (SELECT conv_id, max_by(path, depth) AS path FROM steps GROUP BY conv_id) GROUP BY path
        ), nodes AS (
            SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM steps GROUP BY path
        ), kids AS (
            SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
        ), marked AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (path)
        ), below AS (
            SELECT path[1 : d] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * words) AS saved
            FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM marked) GROUP BY 1
        )
        SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, CASE WHEN m.depth > 0 THEN p.conv_id END AS parent_conv_id, m.n AS n_convs,
            CAST(m.n_children AS BIGINT) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM marked m JOIN below USING (path) LEFT JOIN nodes p ON p.path = m.path[1 : m.depth - 1] AND m.depth > 0 LEFT JOIN ends ON ends.path = m.path
    """,
}
