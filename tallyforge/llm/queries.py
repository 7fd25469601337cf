"""The queries of this subpackage, by name, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path(), length=4096, end_id=2)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.decontaminate import overlaps

    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tallyforge.llm.langid import predict, train

    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)).eqNullSafe(F.lit(2))
    model = train(docs, teaches=~held_out)
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.urlfilter import RULES, judge

    return judge(_table(spark, sf_dir, "pages"), RULES)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.substring import repeats

    return repeats(_table(spark, sf_dir, "documents"), window=35).drop("spans")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.tokenfile import digests, write_tokens

    return digests(write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"), shards=24)


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.ogg import decode, encode
    from tallyforge.llm.runtime import stored

    return decode(stored(encode(_table(spark, sf_dir, "documents")), "media"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.secretscan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.spelling import variants

    return variants(_table(spark, sf_dir, "documents"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tallyforge.llm.neargraph import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, limit=20)


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.treaps import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), limit=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM, _BLACK = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

_OP2 = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
iw AS (SELECT row_number() OVER () AS iid, CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
wins AS (SELECT iid, item, j, list_slice(w, j, j + 9) AS win FROM (SELECT iid, item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS j FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
places AS (SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, k, iid, item, j FROM places JOIN wins ON places.win = wins.win),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
runs AS (SELECT doc_id, iid, n, k, k - j AS diagonal, k - row_number() OVER (PARTITION BY doc_id, iid, k - j ORDER BY k) AS run FROM hits),
lens AS (SELECT doc_id, min(k) - 1 AS word, count(*) + max(n) - 1 AS length FROM runs GROUP BY doc_id, iid, diagonal, run),
longest AS (SELECT doc_id, word, length FROM lens QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, word) = 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(length, 0) AS BIGINT) AS longest_match, CAST(word AS BIGINT) AS match_word
FROM dw LEFT JOIN cover ON dw.doc_id = cover.doc_id LEFT JOIN named ON dw.doc_id = named.doc_id LEFT JOIN longest ON dw.doc_id = longest.doc_id"""

_OP5 = f"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BLACK}') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, list_slice(w, k, k + 3) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM dw WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM dw UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT roots.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, roots.doc_id = component_id AS kept FROM roots LEFT JOIN sizes ON roots.doc_id = sizes.doc_id"""

_OP6 = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLACK}') AS w FROM documents),
wins AS (SELECT doc_id, k, list_slice(w, k, k + 34) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM dw WHERE len(w) >= 35)),
twice AS (SELECT s FROM wins GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM wins JOIN twice ON wins.s = twice.s),
kept AS (SELECT a.doc_id, string_agg(x, ' ' ORDER BY a.p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM dw) a ANTI JOIN gone ON a.doc_id = gone.doc_id AND a.p = gone.p GROUP BY a.doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM dw LEFT JOIN kept ON dw.doc_id = kept.doc_id"""

# Of crc32 (no function of DuckDB's) the table of its bytes, and a fold over the bytes of UTF-8 `<doc_id>:<run>`.
_OP11 = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents) GROUP BY ALL),
bytes AS (SELECT r, c, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, CAST(ord(x) - 64 AS BIGINT)] END)) AS b FROM runs WHERE length(r) >= 6),
sums AS (SELECT r, c, xor(list_reduce(b, lambda h, x: xor(t[xor(h, x) % 256 + 1], h >> 8), 4294967295), 4294967295) AS h FROM bytes, tab),
spoilt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, c FROM sums),
vocabulary AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS replaced, substr(word, 1, i) || substr(word, i + 2) AS shorter FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.replaced = b.replaced AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocabulary b ON a.shorter = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocabulary b ON a.shorter = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(best.n_near, 0) AS n_near, CASE WHEN best.m >= 5 * v.n THEN (SELECT min(other) FROM near WHERE near.word = v.word AND near.m = best.m) END AS form, CASE WHEN best.m >= 5 * v.n THEN best.m END AS form_n FROM vocabulary v LEFT JOIN best ON v.word = best.word),
chase(word, top) AS (SELECT word, word FROM forms UNION ALL SELECT chase.word, forms.form FROM chase JOIN forms ON chase.top = forms.word WHERE forms.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.top AS root FROM forms f JOIN chase c ON c.word = f.word JOIN forms g ON g.word = c.top WHERE g.form IS NULL"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_OP13 = f"""
WITH dw AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '{_TERMS}') AS w FROM documents),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS nn, CAST(sum(len(w)) AS BIGINT) AS l FROM dw),
asked AS (SELECT DISTINCT item_id, text, t FROM (SELECT item_id, text, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS t FROM benchmark)),
tf AS (SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(w) AS t FROM dw) WHERE t IN (SELECT t FROM asked) GROUP BY row, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, totals GROUP BY t, nn),
impacts AS (SELECT tf.row, tf.t, weights.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(dw.w) * nn) // l))) AS s FROM tf JOIN dw ON dw.row = tf.row JOIN weights ON weights.t = tf.t, totals),
scores AS (SELECT item_id, text, row, CAST(sum(s) AS BIGINT) AS score FROM asked JOIN impacts ON impacts.t = asked.t GROUP BY item_id, text, row),
ranks AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores JOIN dw ON dw.row = scores.row WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranks WHERE rank <= 50"""


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables where it can be written and ends in reasonable time on them."""
    return {"op2_decontamination": _OP2.strip(), "op5_near_duplicates": _OP5.strip(), "op6_substrings": _OP6.strip(), "op11_spelling": _OP11.strip(), "op13_ranked": _OP13.strip()}
