"""The queries of this subpackage: each applies its operator to whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SHARDS = 8
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the tokenizer file is on this machine and, installed alike, on every executor."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import HashTree, place

    tree = HashTree.even(SHARDS)
    return place(table(spark, sf_dir, "documents"), tree, tree.grow(SHARDS))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    return judged(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mil import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("copy")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import shares

    return shares(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import trie

    return trie(table(spark, sf_dir, "conversations")).drop("turn")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest, proof, tampered_fifth

    found = manifest(table(spark, sf_dir, "documents"), tampered=tampered_fifth())
    return found.select("doc_id", "leaf", "subroot", "root", proof().alias("proof_sha256"), "folded_root", "verified")


QUERIES = {"op1_simhash": op1_simhash, "op2_sharding": op2_sharding, "op3_quality_rules": op3_quality_rules, "op4_quality_classifier": op4_quality_classifier, "op5_pii": op5_pii, "op6_substring_dedup": op6_substring_dedup, "op7_decontamination": op7_decontamination, "op8_language_id": op8_language_id, "op9_bpe": op9_bpe, "op10_warc": op10_warc, "op11_mixing": op11_mixing, "op12_prefix_trie": op12_prefix_trie, "op13_merkle_manifest": op13_merkle_manifest}


def _draw(name: str, weight: int) -> str:
    return f"-ln((('0x' || substr(md5(k || '|{name}'), 1, 13))::BIGINT + 1) / 4503599627370496.0) / {weight}"


def _sharding_sql() -> str:
    """The tree of eight shards written out: two regions of weight 4, four racks of weight 2, eight shards of weight 1, and a third region of weight 1 once grown."""
    draws = [("r0", 4), ("r1", 4), ("r2", 1), *((f"r{r}k{k}", 2) for r in (0, 1) for k in (0, 1)), *((f"s{s}", 1) for s in range(8))]
    columns = ", ".join(f"{_draw(n, w)} AS {n}" for n, w in draws)
    rack = lambda a: f"CASE WHEN s{a} <= s{a + 1} THEN {a} ELSE {a + 1} END"
    region = lambda r: f"CASE WHEN r{r}k0 <= r{r}k1 THEN {rack(4 * r)} ELSE {rack(4 * r + 2)} END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
w AS (SELECT *, {columns} FROM d),
p AS (SELECT *, CASE WHEN r0 <= r1 THEN {region(0)} ELSE {region(1)} END AS shard FROM w)
SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
  CAST(CASE WHEN r2 < least(r0, r1) THEN 8 ELSE shard END AS INTEGER) AS grown_shard
FROM p"""


ORACLE_SQL: dict[str, str] = {}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_SUBSTRING_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 19], ' ')) AS h FROM k),
f AS (SELECT h, min((doc_id, s)) AS first FROM h GROUP BY h HAVING count(*) > 1),
l AS (SELECT doc_id, s FROM h JOIN f USING (h) WHERE (doc_id, s) > first),
r AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM l) GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT DISTINCT doc_id, unnest(gone) AS i FROM r),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS t, count(*) AS n FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.i = u.i WHERE g.i IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATION_SQL = f"""
WITH b AS (SELECT item_id, {_TERMS} AS w FROM benchmark), d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
bw AS (SELECT item_id, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s, w FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM bw),
sizes AS (SELECT DISTINCT n FROM bs),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, sizes WHERE len(w) >= n),
ds AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM dw),
m AS (SELECT doc_id, item_id, s, ds.n FROM ds JOIN bs ON bs.n = ds.n AND bs.t = ds.t),
hits AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN strlen(h) >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m"""

_CRC = "list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, tbl[CAST(xor(a, b) & 255 AS INTEGER) + 1]))"
_CRC_TABLE = "SELECT list(v ORDER BY i) AS tbl FROM (SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))"
_SHARDING_SQL = f"""WITH placed AS ({_sharding_sql()}), tb AS ({_CRC_TABLE}),
raw AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
crc AS (SELECT doc_id, CAST(xor({_CRC}, 4294967295) AS BIGINT) AS text_crc32 FROM raw, tb)
SELECT placed.*, text_crc32 FROM placed JOIN crc USING (doc_id)"""

ORACLE_SQL |= {"op2_sharding": _SHARDING_SQL, "op6_substring_dedup": _SUBSTRING_SQL, "op7_decontamination": _DECONTAMINATION_SQL, "op10_warc": _WARC_SQL}

_MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE turn % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS most FROM s),
o AS (SELECT *, row_number() OVER o AS place, CAST(1.5 * sum(source_size) OVER () AS DOUBLE) - (sum(most) OVER o - most) AS rest, sum(weight) OVER () - sum(weight) OVER o + weight AS others FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min(rest / others, place) AS level FROM o WHERE most / weight > rest / others),
t AS (SELECT source, source_size, CASE WHEN most / weight <= rest / others THEN most ELSE weight * level END AS target FROM o, l),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id) AS words FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN target > 0 THEN CAST(words + copy * source_size AS DOUBLE) / target ELSE 0 END AS finish FROM q, range(2) r(copy)),
p AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, copy, draw, doc_id ROWS UNBOUNDED PRECEDING) AS position FROM c)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN position <= (SELECT sum(target) FROM t) + 1e-6 THEN size ELSE 0 END) AS BIGINT) AS taken FROM p GROUP BY doc_id, size, source_size, target"""


def _decimal_crc(name: str, table: str) -> str:
    """A table of the distinct values of a column with the CRC-32 of their decimals."""
    return f"""tb AS ({_CRC_TABLE}), raw AS (SELECT DISTINCT {name}, list_transform(string_split(CAST({name} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes FROM {table}),
crc AS (SELECT {name}, CAST(xor({_CRC}, 4294967295) AS BIGINT) AS crc FROM raw, tb)"""


_TRIE_SQL = f"""
WITH {_decimal_crc("conv_id", "conversations")},
c AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own FROM conversations GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:crc % 6], []), c.own[crc % 6 + 1:]) AS turns FROM c JOIN crc USING (conv_id) LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
x AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r),
y AS (SELECT conv_id, depth, len(turns) = depth AS ends, sha256(CAST(to_json(turns[1:depth]) AS VARCHAR)) AS id, CASE WHEN depth > 0 THEN sha256(CAST(to_json(turns[1:depth - 1]) AS VARCHAR)) END AS up, CASE WHEN depth > 0 THEN length(turns[depth].t) ELSE 0 END AS size FROM x),
n AS (SELECT id, depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS own, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM y GROUP BY id, depth),
k AS (SELECT up AS id, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, p.conv_id AS parent_conv_id FROM n LEFT JOIN k USING (id) LEFT JOIN (SELECT id AS up, conv_id FROM n) p USING (up)),
t AS (SELECT a.id, sum(m.own) AS saved_tokens, count(*) FILTER (m.n_children = 0) AS n_leaves FROM m JOIN y u ON u.conv_id = m.conv_id AND u.depth <= m.depth JOIN n a ON a.id = u.id GROUP BY a.id)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM m JOIN t USING (id)"""


def _level_sql(a: str, b: str) -> str:
    return f"{b} AS (SELECT g, pos // 16 AS pos, CASE WHEN max(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d, (max(n) + 15) // 16 AS n FROM {a} GROUP BY g, pos // 16)"


def _sides_sql(a: str) -> str:
    side = lambda x: f"coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos {x} a.pos), '')"
    return f"s{a} AS (SELECT a.g, a.pos, a.n, {side('<')} AS l, {side('>')} AS r FROM {a} a JOIN {a} b ON a.g = b.g AND a.pos // 16 = b.pos // 16 GROUP BY a.g, a.pos, a.n)"


def _merkle_sql(levels: int = 5, tops: int = 3) -> str:
    """For up to 16**levels rows of a source and 16**tops sources."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: f"sha256({' || '.join(map(part, ('doc_id', 'documents.source', 'lang', 'n_chars', text)))})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    below, above = [f"b{i}" for i in range(levels + 1)], [f"t{i}" for i in range(tops + 1)]
    ups = [_level_sql(x, y) for x, y in (*zip(below, below[1:], strict=False), *zip(above, above[1:], strict=False))]
    steps = [(f"sb{i}", "v.g", "v.pos", 16**i) for i in range(levels)] + [(f"st{i}", "0", "v.g", 16**i) for i in range(tops)]
    joins = " ".join(f"JOIN {s} ON {s}.g = {g} AND {s}.pos = {pos} // {d}" for s, g, pos, d in steps)
    folds, last = [], "v"
    for i, (s, *_) in enumerate(steps):
        folds.append(f"f{i} AS (SELECT * REPLACE (CASE WHEN {s}n = 1 THEN cur ELSE sha256({s}l || cur || {s}r) END AS cur) FROM {f'f{i - 1}' if i else 'j'})")
        last = f"f{i}"
    proof = " || ".join(f"CASE WHEN {s}n = 1 THEN '' ELSE {s}l || {s}r END" for s, *_ in steps)
    columns = ", ".join(f"{s}.n AS {s}n, {s}.l AS {s}l, {s}.r AS {s}r" for s, *_ in steps)
    sources = "so AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM documents GROUP BY source)"
    v = f"v AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS pos, {leaf('text')} AS leaf, CASE WHEN crc % 5 = 0 THEN {leaf(low)} END AS changed FROM documents JOIN so ON so.source IS NOT DISTINCT FROM documents.source JOIN crc USING (doc_id))"
    return f"""
WITH {_decimal_crc("doc_id", "documents")}, {sources}, {v},
b0 AS (SELECT g, pos, leaf AS d, n FROM v), {", ".join(ups[:levels])},
t0 AS (SELECT 0 AS g, g AS pos, d, (SELECT count(*) FROM so) AS n FROM {below[-1]}), {", ".join(ups[levels:])},
{", ".join(map(_sides_sql, [*below[:-1], *above[:-1]]))},
j AS (SELECT v.doc_id, v.leaf, coalesce(v.changed, v.leaf) AS cur, t0.d AS subroot, (SELECT d FROM {above[-1]}) AS root, {columns} FROM v JOIN t0 ON t0.pos = v.g {joins}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM {last}"""


ORACLE_SQL |= {"op11_mixing": _MIXING_SQL, "op12_prefix_trie": _TRIE_SQL, "op13_merkle_manifest": _merkle_sql()}
