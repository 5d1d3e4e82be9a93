"""The registered queries of this subpackage: thin steps from the given tables and back."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, languages, licences, lines, manifest, near, packing, passages, pieces, prompts, secrets, toxicity, voices
from .common import Scratch, hex_sha

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("vid"), "text")


SECRETS_SQL = "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), raw AS (" + " UNION ALL ".join(
    f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, {"'" + r.tail.replace("'", "''") + "'" if r.tail else "''"} AS tail,
  regexp_extract_all(text, '{r.regex.replace("'", "''")}') AS m, string_split_regex(text, '{r.regex.replace("'", "''")}') AS p
  FROM t WHERE regexp_matches(text, '{r.regex.replace("'", "''")}')""" for rank, r in enumerate(secrets.RULES)) + """),
x AS (SELECT doc_id, rank, kind, least, tail, m, p, unnest(range(1, len(m) + 1)) AS i FROM raw),
f AS (SELECT doc_id, rank, kind, least, tail, m[i] AS hit, CAST(list_sum(list_transform(p[1:i], lambda s: length(s)))
  + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) AS BIGINT) AS a FROM x),
g AS (SELECT doc_id, rank, kind, a, a + length(hit) AS e FROM f
  WHERE length(CASE WHEN tail = '' THEN hit ELSE regexp_replace(hit, tail, '') END) >= least),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank) FILTER (rank < 3) AS base,
  string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank) AS spans FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN s USING (doc_id)"""


@query("op1_secret_scan", SECRETS_SQL)
def op1_secret_scan(spark, sf_dir):
    docs = documents(spark, sf_dir)
    ledger = Scratch(spark).keep(secrets.scan(docs), "ledger")  # written first: the join after it can then split a hot text
    found = secrets.report(docs, ledger)
    base = F.filter("findings", lambda f: f["kind"].isin(*secrets.BASE))

    def n(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(F.col("vid").alias("doc_id"), n("assign"), n("access"), n("hex"),
                        hex_sha(secrets.span_list(base)).alias("base_sha256"),
                        secrets.span_list(F.col("findings")).alias("spans"))


LINES_SQL = """WITH l AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)),
c AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
r AS (SELECT l.*, c.keeper IS NOT NULL AND l.doc_id <> c.keeper AS lost FROM l LEFT JOIN c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256 FROM r GROUP BY doc_id"""


@query("op2_line_dedup", LINES_SQL)
def op2_line_dedup(spark, sf_dir):
    out = lines.dedup_lines(documents(spark, sf_dir), Scratch(spark))
    return out.select(F.col("vid").alias("doc_id"), "n_lines", "n_dropped", hex_sha(F.col("text")).alias("kept_sha256"))


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(documents(spark, sf_dir), model=model), model=model)
    return back.select(F.col("vid").alias("doc_id"), F.size("ids").cast("bigint").alias("n_ids"), "ids",
                       hex_sha(F.col("text")).alias("decoded_sha256"))


@query("op5_packing")
def op5_packing(spark, sf_dir):
    out = packing.pack(documents(spark, sf_dir), Scratch(spark), tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("vid").alias("doc_id"), "start", "length", F.crc32("tokens").alias("ids_crc32"),
                      "doc_tokens", "sequence_id", "offset")


EXACT_SQL = r"""WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)"""


@query("op7_exact_dedup", EXACT_SQL)
def op7_exact_dedup(spark, sf_dir):
    out = exact.exact_copies(documents(spark, sf_dir), Scratch(spark))
    return out.select(F.col("vid").alias("doc_id"), F.col("keep_vid").alias("keep_id"), F.col("copies").alias("group_size"),
                      "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op10_license_scan")
def op10_license_scan(spark, sf_dir):
    out = licences.licence_scan(documents(spark, sf_dir))
    word = F.transform("places", lambda p: p["word"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    return out.select(F.col("vid").alias("doc_id"), "n_words", F.size("places").cast("bigint").alias("n_base"),
                      F.array_min(word).cast("bigint").alias("first_word"), F.array_max(word).cast("bigint").alias("last_word"),
                      F.array_join(base, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def held_out(vid):
    """Rows whose labels are never learned from."""
    return F.crc32(vid.cast("string").cast("binary")) % 4 == 2


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("vid"), "toxic")
    out = toxicity.score(documents(spark, sf_dir), labels.where(~held_out(F.col("vid"))), Scratch(spark))
    return out.select(F.col("vid").alias("doc_id"), held_out(F.col("vid")).alias("held_out"), "score", F.col("toxic").alias("predicted"))


VOICES_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT *, list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b) AS q FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(q)) AS e FROM g WHERE q > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""


@query("op9_embedding_dedup", VOICES_SQL)
def op9_embedding_dedup(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("voice"), F.col("label").alias("language"), "embedding")
    out = voices.near_voices(rows, Scratch(spark))
    return out.select(F.col("voice").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query("op4_minhash_dedup")
def op4_minhash_dedup(spark, sf_dir):
    out = near.near_classes(documents(spark, sf_dir), Scratch(spark))
    return out.select(F.col("vid").alias("doc_id"), F.col("class_vid").alias("class_id"), "class_size", "kept")


SIDES = ("doc_id", "start", "end", "words", "other_id", "other_start", "other_end", "other_words")


@query("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    """Every passage as a row of either of its documents, so that each one's own rows name all its spans."""
    out = passages.shared_passages(documents(spark, sf_dir), Scratch(spark))
    side = lambda *names: F.struct(*[F.col(c).alias(n) for c, n in zip(names, SIDES, strict=True)], "identity")
    one, two = ("vid", "start", "end", "words"), ("other_vid", "other_start", "other_end", "other_words")
    return out.select(F.explode(F.array(side(*one, *two), side(*two, *one))).alias("row")).select("row.*")


A_Z, A_Z_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CRC_SQL = """bits AS (SELECT i AS byte, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) r(i) UNION ALL
  SELECT byte, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8)"""


def _crc_sql(digits: str) -> str:
    """Unsigned crc32 of a decimal number; ``crc_table`` must be joined."""
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({digits} AS VARCHAR), ''), "
            "lambda d: CAST(ascii(d) AS BIGINT))), lambda a, b: xor(t[1 + (xor(a, b) & 255)], a // 256)), 4294967295)")


def _manifest_sql(levels: int) -> str:
    """Up to 16^levels documents a source, and as many sources; above its top, a tree hands its digest on."""
    def leaf(text):
        return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
                                      for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    ctes = [CRC_SQL, f"""l0 AS MATERIALIZED (SELECT doc_id, source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS place,
  {leaf('text')} AS h, {leaf("(CASE WHEN " + _crc_sql('doc_id') + f" % 5 = 0 THEN translate(text, '{A_Z}', '{A_Z_LOW}') ELSE text END)")} AS now
  FROM documents, crc_table)"""]

    def grow(name):
        for k in range(1, levels + 1):
            ctes.append(f"""{name}{k} AS MATERIALIZED (SELECT tree, place // 16 AS place, list(h ORDER BY place) AS run, any_value(n) AS below,
  CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY place)) END AS h
  FROM (SELECT tree, place, h, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k - 1}) GROUP BY tree, place // 16)""")

    grow("l")
    ctes.append(f"s0 AS MATERIALIZED (SELECT 0 AS tree, tree AS source, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place FROM l{levels})")
    grow("s")
    proof, fold, joins = [], "l0.now", []
    for name in "ls":
        if name == "s":
            joins.append("JOIN s0 ON s0.source IS NOT DISTINCT FROM l0.tree")
        for k in range(1, levels + 1):
            t, slot = f"{name}{k}", f"({name}0.place // {16 ** (k - 1)}) % 16"
            left, right = f"array_to_string({t}.run[1:{slot}], '')", f"array_to_string({t}.run[{slot} + 2:], '')"
            joins.append(f"JOIN {t} ON {t}.tree IS NOT DISTINCT FROM {name}0.tree AND {t}.place = {name}0.place // {16 ** k}")
            joins.append(f"CROSS JOIN LATERAL (SELECT CASE WHEN {t}.below = 1 THEN {fold} ELSE sha256({left} || {fold} || {right}) END AS h) AS f{t}")
            proof += [left, right]
            fold = f"f{t}.h"
    return f"""WITH RECURSIVE {", ".join(ctes)}
SELECT l0.doc_id, l0.h AS leaf, s0.h AS subroot, s{levels}.h AS root, sha256({" || ".join(proof)}) AS proof_sha256,
  {fold} AS folded_root, {fold} = s{levels}.h AS verified FROM l0 {" ".join(joins)}"""


@query("op11_merkle_manifest", _manifest_sql(4))
def op11_merkle_manifest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnsRenamed({"source": "vid", "doc_id": "id"})
    edited = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    out = manifest.manifest(rows, Scratch(spark), fields=("id", "vid", "lang", "n_chars", "text"),
                            now={"text": F.when(edited, F.translate("text", A_Z, A_Z_LOW)).otherwise(F.col("text"))})
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


TRIE_SQL = f"""WITH RECURSIVE {CRC_SQL},
t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, CAST({_crc_sql('conv_id')} % 4 AS BIGINT) AS h FROM t, crc_table),
r AS (SELECT a.conv_id, list_concat(coalesce(b.turns[1:h], []), a.turns[h + 1:]) AS seq
  FROM h a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 20),
m AS (SELECT conv_id, d, seq[1:d] AS node, len(seq) AS n FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM r)),
nodes AS MATERIALIZED (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY node, d),
own AS MATERIALIZED (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node[d].t, '[^\\x20\\x09-\\x0D]+')) END AS own FROM nodes),
kids AS MATERIALIZED (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT own.*, coalesce(kids.n, 0) AS n_children FROM own LEFT JOIN kids USING (node, d))
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, b.n_leaves, b.saved_tokens, a.ends_sha256
FROM whole a JOIN (SELECT x.node, x.d, count(*) FILTER (below.n_children = 0) AS n_leaves, CAST(sum(below.own) AS BIGINT) AS saved_tokens
    FROM (SELECT unnest(range(d + 1)) AS top, * FROM whole) below, LATERAL (SELECT below.node[1:top] AS node, top AS d) AS x(node, d)
    GROUP BY x.node, x.d) b(node, d, n_leaves, saved_tokens) ON b.node = a.node AND b.d = a.d
  LEFT JOIN nodes p ON a.d > 0 AND p.node = a.node[1:a.d - 1] AND p.d = a.d - 1"""


@query("op13_prefix_trie", TRIE_SQL)
def op13_prefix_trie(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumnsRenamed({"conv_id": "request", "text": "content"})
    c = F.col("request")
    out = prompts.prompt_trie(rows, Scratch(spark), base=c - c % 20, shared=F.crc32(c.cast("string").cast("binary")) % 4)
    return out.select(c.alias("conv_id"), "depth", F.col("parent_request").alias("parent_conv_id"), F.col("requests").alias("n_convs"),
                      F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), "saved_tokens", "ends_sha256")


@query("op12_language_id")
def op12_language_id(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("vid"), "text", F.col("lang").alias("source_lang"))
    out = languages.spoken_language(rows, Scratch(spark), learn=~held_out(F.col("vid")))
    return out.select(F.col("vid").alias("doc_id"), held_out(F.col("vid")).alias("held_out"), F.col("source_lang").alias("lang_pred"), "score")
