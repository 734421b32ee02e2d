"""The numbered queries, each an operator over its whole table, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import (
    contamination,
    extraction,
    line_dedup,
    near_dedup,
    neighbours,
    packing,
    prefix_trie,
    quality,
    secrets,
    sharding,
    token_alignment,
    token_counts,
    toxicity,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Fixed value: the letters that the contracts fold.
FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_decontamination",
    rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM documents),
d AS (SELECT doc_id, coalesce(w, []) AS w FROM w),
i AS (SELECT item_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS n,
             array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k
            FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
            FROM d, lengths WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, k, g.n FROM g JOIN p USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
        FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
)
def op1_decontamination(spark, folder):
    return contamination.report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@query(
    "op8_line_dedup",
    rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
           FROM documents),
w AS (SELECT doc_id, line_no, line,
             regexp_extract_all({FOLDED.replace("text", "line")}, '[^\x20\x09-\x0D]+') AS w FROM l),
p AS (SELECT *, len(w) AS n, array_to_string(w, ' ') AS s,
             row_number() OVER (ORDER BY doc_id, line_no) AS place FROM w WHERE len(w) >= 5),
u AS (SELECT s, any_value(w) AS w, any_value(n) AS n, min(place) AS place FROM p GROUP BY s),
v AS (SELECT s, n, place, k, array_to_string(list_concat(w[:k - 1], w[k + 1:]), ' ') AS cut
      FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM u WHERE n >= 10)),
near AS (
  SELECT a.s, b.first FROM v a
    JOIN (SELECT n, k, cut, min(place) AS first FROM v GROUP BY ALL) b USING (n, k, cut)
  UNION ALL
  SELECT v.s, u.place FROM v JOIN u ON u.s = v.cut WHERE u.n >= 10
  UNION ALL
  SELECT u.s, v.place FROM v JOIN u ON u.s = v.cut WHERE u.n >= 10),
e AS (SELECT s, least(min(u.place), min(near.first)) AS earliest
      FROM u LEFT JOIN near USING (s) GROUP BY s),
gone AS (SELECT doc_id, line_no FROM p JOIN e USING (s) WHERE earliest < place)
SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no)
         FILTER (WHERE gone.line_no IS NULL), '') AS text,
       count(*) AS n_lines, count(gone.line_no) AS n_removed
FROM l LEFT JOIN gone USING (doc_id, line_no) GROUP BY l.doc_id
""",
)
def op8_line_dedup(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.without_repeats(docs)


@query(
    "op9_near_dedup",
    rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all({FOLDED}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k
            FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
         FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b
         WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT a AS doc_id, a AS other FROM link UNION
          SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a),
least_id AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles,
       coalesce(component_id, w.doc_id) AS component_id,
       coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN least_id USING (doc_id)
""",
)
def op9_near_dedup(spark, folder):
    return near_dedup.groups(_table(spark, folder, "documents"))


def vocabulary(name):
    """Content of a public vocabulary file; its place is a parameter of the operators."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@query("op3_packing")
def op3_packing(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


@query("op6_quality")
def op6_quality(spark, folder):
    return quality.report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def _secret_sql():
    """Spans from the lengths of matches and of what is between them, for each rule."""
    parts = []
    for order, rule in enumerate(secrets.RULES):
        code = rule.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, '{rule.kind}' AS kind, {order} AS k,
  list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS start,
  length(hit[i]) AS size
FROM (SELECT *, unnest(range(1, len(hit) + 1)) AS i
      FROM (SELECT doc_id, string_split_regex(text, '{code}') AS gap,
                   regexp_extract_all(text, '{code}', 0) AS hit,
                   regexp_extract_all(text, '{code}', {rule.group}) AS part FROM d))
WHERE length(part[i]) >= {rule.least}"""
        )
    base = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    listed = "coalesce(string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, k)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(parts)}),
a AS (SELECT doc_id, {base}, {listed} FILTER (WHERE k < {len(secrets.BASE)}), '') AS base, {listed}, '') AS spans
      FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""


@query("op10_secrets", _secret_sql())
def op10_secrets(spark, folder):
    return secrets.report(_table(spark, folder, "documents"))


@query("op5_token_counts")
def op5_token_counts(spark, folder):
    return token_counts.report(_table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op7_neighbours")
def op7_neighbours(spark, folder):
    return neighbours.report(_table(spark, folder, "embeddings"))


@query("op2_toxicity")
def op2_toxicity(spark, folder):
    return toxicity.report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query("op4_extraction")
def op4_extraction(spark, folder):
    return extraction.extract(_table(spark, folder, "pages"))


def _crc32_sql(blob):
    """Unsigned CRC-32 of a blob, byte by byte; DuckDB has no function for it."""
    table = []
    for code in range(256):
        for _ in range(8):
            code = code >> 1 ^ (0xEDB88320 if code & 1 else 0)
        table.append(code)
    octets = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    step = f"xor(({table})[1 + (xor(c, b) & 255)], c >> 8)"
    return f"xor(list_reduce({octets}, lambda c, b: {step}, 4294967295), 4294967295)"


def _sharding_sql(shards, cells, replicas):
    """The waves over the cells of the ring, one after the other."""
    position = f"CAST('0x' || substr(md5({{}}), 1, 8) AS BIGINT) % {cells}"
    waves = []
    for k in range(shards + 1):
        waves.append(
            f"""t{k} AS MATERIALIZED (SELECT cell, n, done, arg_min(shard, far) AS shard FROM l{k} JOIN pref USING (cell)
  JOIN u{k} USING (shard) WHERE n > 0 AND used < room GROUP BY ALL),
w{k} AS MATERIALIZED (SELECT cell, n, done, shard, used + before AS first, greatest(0, least(n, room - used - before)) AS take
  FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM t{k} JOIN u{k} USING (shard))),
l{k + 1} AS MATERIALIZED (SELECT cell, n - take AS n, done + take AS done FROM w{k}),
u{k + 1} AS MATERIALIZED (SELECT shard, room, used + coalesce((SELECT sum(take) FROM w{k} WHERE w{k}.shard = u.shard), 0) AS used FROM u{k} u),"""
        )
    ranges = " UNION ALL ".join(f"SELECT cell, done AS low, done + take AS high, shard, first FROM w{k} WHERE take > 0" for k in range(shards + 1))
    return f"""WITH x AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
y AS (SELECT doc_id, CAST(octet_length(b) + 1 AS BIGINT) AS size, CAST({_crc32_sql("b")} AS BIGINT) AS text_crc32 FROM x),
d AS MATERIALIZED (SELECT *, {position.format("coalesce(CAST(doc_id AS VARCHAR), '')")} AS cell,
       md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || text_crc32) AS o FROM y),
v AS (SELECT s AS shard, {position.format("'shard-' || s || '-' || r")} AS cell FROM range({shards}) a(s), range({replicas}) b(r)),
l0 AS MATERIALIZED (SELECT cell, count(*) AS n, 0 AS done FROM d GROUP BY cell),
pref AS MATERIALIZED (SELECT l0.cell, shard, min((v.cell - l0.cell + {cells}) % {cells} * {shards} + shard) AS far FROM l0, v GROUP BY ALL),
wanted AS (SELECT s AS shard, coalesce(sum(n), 0) AS n FROM range({shards}) a(s)
  LEFT JOIN (SELECT cell, any_value(n) AS n, arg_min(shard, far) AS shard FROM l0 JOIN pref USING (cell) GROUP BY cell) f ON shard = s GROUP BY s),
u0 AS MATERIALIZED (SELECT shard, 0 AS used, t // {shards} + CAST(row_number() OVER (ORDER BY n DESC, shard) <= t % {shards} AS INTEGER) AS room
  FROM wanted, (SELECT count(*) AS t FROM d)),
{chr(10).join(waves)}
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY o, doc_id NULLS FIRST, size, text_crc32) - 1 AS rank FROM d),
g AS ({ranges})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(first + rank - low AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN g ON r.cell = g.cell AND rank >= low AND rank < high"""


@query("op13_sharding", _sharding_sql(8, sharding.CELLS, sharding.REPLICAS))
def op13_sharding(spark, folder):
    return sharding.report(_table(spark, folder, "documents"))


@query(
    "op11_prefix_trie",
    f"""
WITH t AS (SELECT conv_id, md5(coalesce(text, '')) || md5(coalesce(role, '')) AS h, length(coalesce(text, '')) AS size,
                  row_number() OVER (PARTITION BY conv_id
                    ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, {_crc32_sql("encode(CAST(conv_id AS VARCHAR))")} % 6 AS n
                   FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, k, h, size FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND k <= n
      UNION ALL SELECT conv_id, k, h, size FROM c JOIN t USING (conv_id) WHERE k > n),
p AS (SELECT conv_id, coalesce(list(h ORDER BY k) FILTER (WHERE h IS NOT NULL), []) AS path,
             coalesce(list(size ORDER BY k) FILTER (WHERE h IS NOT NULL), []) AS sizes
      FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
m AS MATERIALIZED (SELECT conv_id, d, len(path) AS n, coalesce(sizes[d], 0) AS size,
             md5(array_to_string(path[1:d], '')) AS node, md5(array_to_string(path[1:d - 1], '')) AS above
      FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM p)),
q AS MATERIALIZED (SELECT d, node, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
             string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d) AS ends
      FROM m GROUP BY d, node),
k AS (SELECT d - 1 AS d, above AS node, count(*) AS n FROM q WHERE d > 0 GROUP BY ALL),
s AS (SELECT m.d, m.node, count(*) FILTER (WHERE k.n IS NULL) AS leaves, sum((q.n_convs - 1) * q.size) AS saved
      FROM q LEFT JOIN k USING (d, node) JOIN m ON m.conv_id = q.conv_id AND m.d <= q.d GROUP BY ALL)
SELECT q.conv_id, q.d AS depth, u.conv_id AS parent_conv_id, q.n_convs, coalesce(k.n, 0) AS n_children,
       leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(q.ends, '')) AS ends_sha256
FROM q LEFT JOIN k USING (d, node) JOIN s USING (d, node) LEFT JOIN q u ON q.d > 0 AND u.d = q.d - 1 AND u.node = q.above
""",
)
def op11_prefix_trie(spark, folder):
    return prefix_trie.report(_table(spark, folder, "conversations"))


def _model(name):
    """A public vocabulary file as it is."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@query("op12_token_alignment")
def op12_token_alignment(spark, folder):
    return token_alignment.report(
        _table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), _model("piece_bpe_32k.model")
    )
