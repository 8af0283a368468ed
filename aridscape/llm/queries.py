"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aridscape.llm import ann, bpe, chat, crosstok, huffman, katz, mixing, packing, pages, quality, simhash, substring, trie
from aridscape.llm.common import scratch_path

def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept")


@query("op5_simhash")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS c FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, CAST(sum(c) OVER () AS DOUBLE) AS total,
             coalesce(sum(3 * c) OVER (ORDER BY 3.0 * c / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(weight) OVER (ORDER BY 3.0 * c / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
      FROM w),
f AS (SELECT *, (total - below) / open_weight AS level, row_number() OVER (ORDER BY 3.0 * c / weight, source) AS place FROM o),
l AS (SELECT arg_min(level, place) AS level, min(place) AS place FROM f WHERE level * weight < 3 * c),
t AS (SELECT f.source, f.c, CASE WHEN f.place >= l.place THEN l.level * f.weight ELSE CAST(3 * f.c AS DOUBLE) END AS target FROM f, l),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
g AS (SELECT *, CASE WHEN c > 0 AND quota > 0 THEN (quota - 1) // c ELSE 0 END AS full_copies FROM q),
r AS (SELECT d.doc_id, d.size, g.c, g.target, g.quota, g.full_copies,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, c AS source_size, round(target, 6) AS target,
       CAST(size * (full_copies + CASE WHEN 2 * start + size <= 2 * (quota - full_copies * c) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


@query("op3_mixing", MIXING_SQL)
def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"), seed=17)


@query("op4_packing")
def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=1, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op6_substring")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated(table(spark, sf_dir, "documents"), similarity=0.8)


@query("op10_huffman")
def huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_path(spark, 'huffman')}/files"
    huffman.write(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), drops_space=True, end_id=2)
    return huffman.checksums(huffman.read(spark, path))


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
             sum(12 + length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\', '\\'), chr(10), '\n')) + 1
                 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 11) OVER w AS upto
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR pos = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""


@query("op7_chat", CHAT_SQL)
def chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    return chat.digest(chat.examples(turns.union(extra)))


@query("op2_neighbours")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0, k=20)


@query("op9_html")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(table(spark, sf_dir, "pages"))


@query("op1_katz")
def katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), order=3)


TRIE_SQL = r"""
WITH bits AS (
  SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(n)),
crc AS (SELECT list(v ORDER BY n) AS step FROM bits),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
             sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h
      FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, h) AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
             xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                             lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS first
      FROM (SELECT DISTINCT conv_id FROM t), crc),
u AS (SELECT c.conv_id, 0 AS own, o.pos, o.h, o.text FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.first
      UNION ALL SELECT c.conv_id, 1, o.pos, o.h, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.first),
p AS (SELECT conv_id, row_number() OVER w AS depth, sha256(string_agg(h, '') OVER w) AS node, strlen(text) AS bytes FROM u
      WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
      UNION ALL SELECT conv_id, 0, 'root', 0 FROM c),
n AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(bytes) AS bytes FROM p GROUP BY node),
e AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
      FROM (SELECT conv_id, arg_max(node, depth) AS node FROM p GROUP BY conv_id) GROUP BY node),
g AS (SELECT n.node, p.node AS up FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
k AS (SELECT up AS node, count(*) AS n_children FROM g GROUP BY up),
s AS (SELECT a.node, sum(CASE WHEN k.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
      FROM n JOIN p a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN k ON k.node = n.node GROUP BY a.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN g ON g.node = n.node LEFT JOIN n m ON m.node = g.up LEFT JOIN k ON k.node = n.node
JOIN s ON s.node = n.node LEFT JOIN e ON e.node = n.node
"""


@query("op11_prefix_trie", TRIE_SQL)
def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = trie.paths(table(spark, sf_dir, "conversations"))
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    turns = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    return trie.nodes(trie.with_heads(convs, base, turns, most=8))


@query("op13_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op12_cross_tokenizer")
def cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.statistics(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
