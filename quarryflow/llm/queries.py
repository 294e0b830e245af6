"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table, texts
from .decontaminate import contaminated
from .html_extract import extract_pages
from .license_scan import scan_licenses
from .minhash import minhash_groups
from .packing import pack
from .pii import find_pii
from .prefix_trie import prefix_trie
from .quality import classify
from .sharding import byte_shards
from .simhash import near_duplicates
from .spelling import spelling_variants
from .substring_dedup import remove_repeats
from .topk import exact_top_k


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(texts(spark, sf_dir, "documents")).drop("kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(texts(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(texts(spark, sf_dir, "pages"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(texts(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(texts(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hamming")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(texts(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(texts(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(texts(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(texts(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_html_extraction": op4_html_extraction,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_minhash": op13_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        win AS (SELECT u, s, md5(array_to_string(w[s + 1:s + 35], ' ')) AS k FROM (SELECT u, w, unnest(range(len(w) - 34)) AS s FROM d WHERE len(w) >= 35)),
        rep AS (SELECT u, s FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT u, p FROM (SELECT u, unnest(range(s, s + 35)) AS p FROM rep)),
        word AS (SELECT u, unnest(w) AS x, unnest(range(len(w))) AS p FROM d),
        kept AS (SELECT word.u, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (u, p) GROUP BY word.u),
        n AS (SELECT u, count(*) AS removed FROM gone GROUP BY u)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (u) LEFT JOIN n USING (u)
    """,
    "op9_packing": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM documents),
        pieces AS (SELECT doc_id, CAST(p AS INTEGER) AS piece, CAST(p * 2048 AS BIGINT) AS start_token, CAST(least(n - p * 2048, 2048) AS BIGINT) AS n_tokens
                   FROM (SELECT doc_id, n, unnest(range(greatest((n + 2047) // 2048, 1))) AS p FROM d)),
        h AS (SELECT n_tokens AS l, count(*) AS c FROM pieces WHERE n_tokens > 0 GROUP BY n_tokens),
        nodes AS (SELECT 0 AS j, 0 AS l, 0 AS r, 0 AS t UNION ALL
                  SELECT row_number() OVER (ORDER BY l), l, CAST(sum(c) OVER (ORDER BY l) AS BIGINT), CAST(sum(c * l) OVER (ORDER BY l) AS BIGINT) FROM h),
        rounds AS (SELECT least(8, max(j)) AS most, max(j) AS m FROM nodes),
        dp(b, j, best) AS (
          SELECT 0, j, {'cost': CASE WHEN j = 0 THEN 0 ELSE 1000000000000 END, 'back': 0} FROM nodes
          UNION ALL
          SELECT dp.b + 1, y.j, min({'cost': CASE WHEN y.j = 0 THEN 0 ELSE dp.best.cost + (y.r - x.r) * y.l - (y.t - x.t) END, 'back': x.j})
          FROM dp JOIN nodes x ON x.j = dp.j JOIN nodes y ON y.j > x.j OR (y.j = 0 AND x.j = 0), rounds WHERE dp.b < most GROUP BY dp.b + 1, y.j),
        chain(b, j) AS (
          SELECT most, m FROM rounds
          UNION ALL SELECT CAST(dp.b - 1 AS BIGINT), dp.best.back FROM chain JOIN dp ON dp.b = chain.b AND dp.j = chain.j WHERE dp.best.back > 0 AND dp.b > 1),
        bounds AS (SELECT DISTINCT nodes.l FROM chain JOIN nodes USING (j) WHERE j > 0),
        placed AS (SELECT *, CASE WHEN n_tokens > 0 THEN (SELECT min(l) FROM bounds WHERE l >= n_tokens) END AS bucket FROM pieces),
        caps AS (SELECT bucket, greatest(32768 // bucket, 1) AS room, count(*) AS k FROM placed WHERE bucket IS NOT NULL GROUP BY bucket),
        bases AS (SELECT *, coalesce(sum((k + room - 1) // room) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM caps),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, piece, n_tokens) - 1 AS rank FROM placed)
        SELECT doc_id, piece, start_token, n_tokens, CAST(ranked.bucket AS INTEGER) AS bucket_len, CAST(base + rank // room AS BIGINT) AS batch,
               CAST(rank % room AS INTEGER) AS slot, CAST(ranked.bucket - n_tokens AS BIGINT) AS padding
        FROM ranked LEFT JOIN bases USING (bucket)
    """,
    "op10_sharding": r"""
        WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                 lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
        t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
        c AS (SELECT doc_id, md5(x) AS k, CAST(octet_length(encode(x)) + 1 AS BIGINT) AS size,
                xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(x)), '..'),
                    lambda b: CAST((instr('0123456789ABCDEF', b[1]) - 1) * 16 + instr('0123456789ABCDEF', b[2]) - 1 AS BIGINT))),
                  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM t, tab),
        o AS (SELECT *, row_number() OVER (ORDER BY k, doc_id, size, text_crc32) - 1 AS pos,
                CAST(sum(size) OVER (ORDER BY k, doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM c),
        total AS (SELECT CAST(sum(size) AS BIGINT) AS total FROM o),
        target AS (SELECT n, n * total // 8 AS cut FROM total, (SELECT unnest(range(1, 8)) AS n)),
        grp AS (SELECT k, min(before) AS lo, max(before + size) AS hi FROM o GROUP BY k),
        near AS (SELECT n, cut, CASE WHEN abs(lo - cut) <= abs(hi - cut) THEN lo ELSE hi END AS edge FROM target JOIN grp ON lo <= cut AND cut < hi),
        cuts AS (SELECT CASE WHEN abs(edge - cut) <= 0.01 * total / 8 THEN edge ELSE cut END AS cut FROM near, total),
        s AS (SELECT *, CAST((SELECT count(*) FROM cuts WHERE cuts.cut <= o.before) AS INTEGER) AS shard FROM o)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(pos - min(pos) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
    """,
    # the pages' markup alone: one article each, h1 and p as blocks, four character references, which may lack the semicolon
    "op4_html_extraction": r"""
        WITH b AS (
          SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), ''), '</?(?:p|h1)>'),
            lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'),
              '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[ \t\n\r]+', ' ', 'g'))), lambda x: x <> '') AS parts FROM pages),
        t AS (SELECT page_id, url, coalesce(array_to_string(parts, chr(10)), '') AS text FROM b)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
    """,
    "op8_decontamination": r"""
        WITH d0 AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
        d AS (SELECT *, row_number() OVER () AS u, len(w) AS nw, greatest(len(w) - 4, 1) AS nd FROM d0 WHERE len(w) >= 1),
        i AS (SELECT row_number() OVER () AS v, item_id, w, greatest(len(w) - 4, 1) AS n FROM (
                SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) >= 1),
        ds AS (SELECT u, p, array_to_string(list_slice(w, p + 1, p + 5), ' ') AS h FROM (SELECT u, w, unnest(range(nd)) AS p FROM d)),
        ish AS (SELECT v, h, count(*) AS c FROM (
                SELECT v, array_to_string(list_slice(w, p + 1, p + 5), ' ') AS h FROM (SELECT v, w, unnest(range(n)) AS p FROM i)) GROUP BY v, h),
        hit AS (SELECT DISTINCT u, v, p, ds.h, c FROM ds JOIN ish USING (h)),
        win AS (SELECT DISTINCT u, v, s FROM (
                SELECT hit.u, hit.v, least(hit.p, greatest(nd - n, 0)) AS s FROM hit JOIN d USING (u) JOIN i USING (v)
                UNION ALL
                SELECT hit.u, hit.v, greatest(nd - n, 0) FROM hit JOIN d USING (u) JOIN i USING (v))),
        both_ AS (SELECT u, v, s, sum(least(k, c)) AS b FROM (
                SELECT win.u, win.v, s, h, c, count(*) AS k FROM win JOIN i USING (v) JOIN hit ON hit.u = win.u AND hit.v = win.v AND p >= s AND p < s + n
                GROUP BY win.u, win.v, s, h, c) GROUP BY u, v, s),
        sim AS (SELECT doc_id, d.u, item_id, s, least(least(n, nd) + 4, nw) AS n_words, b / (least(n, nd) + n - b) AS x
                FROM both_ JOIN d USING (u) JOIN i USING (v))
        SELECT doc_id, item_id, CAST(s AS INTEGER) AS start, CAST(n_words AS INTEGER) AS n_words, round(x, 6) AS similarity FROM (
          SELECT *, row_number() OVER (PARTITION BY u, item_id ORDER BY x DESC, s, n_words) AS r FROM sim WHERE x >= 0.8) WHERE r = 1
    """,
    "op5_exact_top_k": """
        WITH v AS (
          SELECT row_number() OVER () AS uid, vec_id,
                 list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.uid, a.vec_id AS query_id, b.vec_id,
                 CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
          FROM v a JOIN v b ON a.uid <> b.uid WHERE a.vec_id % 50 = 0)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS r FROM s)
        WHERE r <= 5
    """,
    "op11_spelling_variants": r"""
        WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                 lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
        runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
                   unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
        times AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY id, run),
        hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'),
                    lambda b: CAST((instr('0123456789ABCDEF', b[1]) - 1) * 16 + instr('0123456789ABCDEF', b[2]) - 1 AS BIGINT))),
                  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM times, tab),
        w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
                SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
              WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
        less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
        near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
                 UNION SELECT less.word, w.word FROM less JOIN w ON less.d = w.word UNION SELECT w.word, less.word FROM less JOIN w ON less.d = w.word),
        ranked AS (SELECT near.word, other, w.n AS form_n, count(*) OVER (PARTITION BY near.word) AS n_near,
                     row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS r FROM near JOIN w ON w.word = other),
        formed AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN other END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
                   FROM w LEFT JOIN ranked ON ranked.word = w.word AND r = 1),
        walk(word, top) AS (SELECT word, form FROM formed WHERE form IS NOT NULL
                           UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.top WHERE formed.form IS NOT NULL),
        ends AS (SELECT walk.word, top FROM walk JOIN formed ON formed.word = top WHERE formed.form IS NULL)
        SELECT formed.word, form, coalesce(top, formed.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM formed LEFT JOIN ends ON ends.word = formed.word
    """,
    "op12_prefix_trie": r"""
        WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                 lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
        t AS (SELECT conv_id, tid, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tid) AS p FROM (
                SELECT conv_id, turn, md5(CAST(length(role) AS VARCHAR) || ':' || role || text) AS tid, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w
                FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
        ids AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'),
                    lambda b: CAST((instr('0123456789ABCDEF', b[1]) - 1) * 16 + instr('0123456789ABCDEF', b[2]) - 1 AS BIGINT))),
                  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), tab),
        r AS (SELECT ids.conv_id AS c, 0 AS part, p, tid, w FROM ids JOIN t ON t.conv_id = ids.conv_id - ids.conv_id % 20 AND p <= h
              UNION ALL SELECT conv_id, 1, p, tid, w FROM ids JOIN t USING (conv_id) WHERE p > h),
        s AS (SELECT c, tid, w, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d FROM r),
        pre AS (SELECT c, d, w, md5(string_agg(tid, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
        node AS (SELECT d, k, min(c) AS m, count(*) AS n, min(w) AS w FROM pre GROUP BY d, k),
        link AS (SELECT node.d, node.k, pre.k AS pk FROM node JOIN pre ON pre.c = node.m AND pre.d = node.d - 1),
        kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM link GROUP BY d, pk),
        leaves AS (SELECT pre.d, pre.k, count(*) AS n_leaves FROM node JOIN pre ON pre.c = node.m AND pre.d <= node.d
                   WHERE NOT EXISTS (SELECT 1 FROM kids WHERE kids.d = node.d AND kids.k = node.k) GROUP BY pre.d, pre.k),
        saved AS (SELECT pre.d, pre.k, sum((node.n - 1) * node.w) AS saved FROM node JOIN pre ON pre.c = node.m AND pre.d <= node.d GROUP BY pre.d, pre.k),
        last AS (SELECT c, max(d) AS d FROM pre GROUP BY c),
        ends AS (SELECT pre.d, k, sha256(string_agg(CAST(pre.c AS VARCHAR), ',' ORDER BY pre.c)) AS e FROM pre JOIN last ON pre.c = last.c AND pre.d = last.d GROUP BY pre.d, k)
        SELECT node.m AS conv_id, CAST(node.d AS BIGINT) AS depth, up.m AS parent_conv_id, CAST(node.n AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
               CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
        FROM node LEFT JOIN link ON link.d = node.d AND link.k = node.k LEFT JOIN node up ON up.d = node.d - 1 AND up.k = link.pk
        LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k JOIN leaves ON leaves.d = node.d AND leaves.k = node.k
        JOIN saved ON saved.d = node.d AND saved.k = node.k LEFT JOIN ends ON ends.d = node.d AND ends.k = node.k
    """,
    "op13_minhash": r"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT u, array_to_string(w[p + 1:p + 3], ' ') AS h FROM (SELECT u, w, unnest(range(greatest(len(w) - 2, 1))) AS p FROM d WHERE len(w) > 0)),
        n AS (SELECT u, count(*) AS n, md5(string_agg(h, chr(10) ORDER BY h)) AS k FROM s GROUP BY u),
        one AS (SELECT k, min(u) AS u, any_value(n) AS n FROM n GROUP BY k),
        os AS (SELECT s.u, h FROM s JOIN one USING (u)),
        both_ AS (SELECT a.u AS a, b.u AS b, count(*) AS x FROM os a JOIN os b ON a.h = b.h AND a.u < b.u GROUP BY a.u, b.u),
        near AS (SELECT a, b FROM both_ JOIN one p ON p.u = a JOIN one q ON q.u = b WHERE 100 * x >= 85 * (p.n + q.n - x)),
        edge AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
        reach(u, v) AS (SELECT u, u FROM one UNION SELECT reach.u, edge.b FROM reach JOIN edge ON edge.a = reach.v),
        least AS (SELECT k, min(d.doc_id) AS m FROM n JOIN d USING (u) GROUP BY k),
        comp AS (SELECT x.k, min(least.m) AS component_id FROM reach JOIN one x ON x.u = reach.u JOIN one y ON y.u = reach.v JOIN least ON least.k = y.k GROUP BY x.k)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id,
               doc_id IS NOT DISTINCT FROM CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS kept
        FROM d LEFT JOIN n USING (u) LEFT JOIN comp USING (k)
    """,
}
