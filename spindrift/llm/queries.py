"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, chat_format, embedding_dedup, fill_in_middle, importance, language_id, mixing, ngram_jaccard, record_files, spelling, substring_dedup, vector_search, warc

#: The rank file that texts are encoded by, and the pattern that splits them.
RANKS = "byte_bpe_50k.tiktoken"

#: The tokenizer whose ids go into record files, and the id that ends a document there.
WORD_TOKENIZER, END_ID = "word_bpe_49k.json", 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link_components(_table(spark, sf_dir, "documents"), width=5, percent=80)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out()))
    return language_id.identify(docs.select("doc_id", "text"), profiles, keep=["doc_id"]).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(_table(spark, sf_dir, "embeddings"), least=0.98)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0] or 0.0
    return importance.resample(docs, importance.labelled_texts(docs, labels.where("quality = 1")), share)


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return vector_search.search(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, length=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: A conversation whose texts hold control strings.
CONTROL = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_chats(turns.unionByName(extra)))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode_texts(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id"], with_ids=False).drop("token_ids")


def op11_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = record_files.write_records(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), END_ID)
    read = record_files.read_records(files, as_bytes=True)
    n_tokens = F.octet_length("ids_bytes").cast("long") / 4
    return read.select("doc_id", "start", n_tokens.cast("long").alias("n_tokens"), F.crc32("ids_bytes").alias("ids_crc32"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"), seed=7, percent=100, percent_spm=50, keep=["doc_id"])
    text = fill_in_middle.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard, op2_language_id, op3_embedding_dedup, op4_mixing, op5_importance, op6_vector_search, op7_substring_dedup, op8_chat_format, op9_warc, op10_bpe, op11_record_files, op12_spelling, op13_fill_in_middle)}

ORACLE_SQL: dict[str, str] = {}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL["op1_ngram_jaccard"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT x AS doc_id, x AS node FROM both_ways UNION SELECT r.doc_id, b.y FROM r JOIN both_ways b ON b.x = r.node),
c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

_UNITS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

ORACLE_SQL["op3_embedding_dedup"] = f"""
WITH RECURSIVE {_UNITS},
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT DISTINCT x AS vec_id, x AS node FROM e UNION SELECT r.vec_id, e.y FROM r JOIN e ON e.x = r.node),
c AS (SELECT vec_id, min(node) AS c FROM r GROUP BY vec_id), n AS (SELECT x AS vec_id, count(*) AS n FROM e GROUP BY x)
SELECT t.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, t.vec_id)::BIGINT AS component_id, coalesce(c.c, t.vec_id) = t.vec_id AS kept
FROM embeddings t LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)"""

ORACLE_SQL["op6_vector_search"] = f"""
WITH {_UNITS}, q AS (SELECT vec_id, list_transform(v, lambda x: floor(256 * x)) AS f FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.f, b.f)::BIGINT AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5"""

ORACLE_SQL["op7_substring_dedup"] = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM p) WHERE n > 1),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
k AS (SELECT u.doc_id, u.j, u.word, max(d.i) OVER (PARTITION BY u.doc_id ORDER BY u.j) AS near FROM u LEFT JOIN d ON d.doc_id = u.doc_id AND d.i = u.j),
x AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE near IS NOT NULL AND near > j - 35) AS gone, string_agg(word, ' ' ORDER BY j) FILTER (WHERE near IS NULL OR near <= j - 35) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN x USING (doc_id)"""

ORACLE_SQL["op8_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, length(role || text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) + 10 AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id"""

# base32 of a digest: 32 groups of five bits
ORACLE_SQL["op9_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, hex, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 10 * (g // 8), 10))::BIGINT >> (35 - 5 * (g % 8))) & 31)::INTEGER, 1), '' ORDER BY g) FROM range(32) AS r(g)) AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM m"""

# crc32 of the bytes of a string, four bits at a time; deletions stand for near words: two of equal length share one at the
# same place, a shorter one is one of a longer one
ORACLE_SQL["op12_spelling"] = r"""
WITH RECURSIVE table16 AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS c FROM range(16) AS r(i))),
r AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL HAVING length(run) >= 7),
b AS (SELECT doc_id, run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(length(x) // 2), lambda i: [('0x' || x[2 * i + 2])::BIGINT, ('0x' || x[2 * i + 1])::BIGINT]))),
       lambda a, d: xor(a >> 4, t[xor(a & 15, d) + 1])), 4294967295::BIGINT) AS h FROM b, table16),
w AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
d AS (SELECT word, n, length(word) AS l, i, left(word, i) || substr(word, i + 2) AS less FROM w, unnest(range(length(word))) AS u(i)),
e AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.l = b.l AND a.i = b.i AND a.less = b.less AND a.word <> b.word
      UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.less UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.less),
f AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM e GROUP BY word),
g AS (SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.most >= 10 * w.n THEN f.most END AS form_n, (SELECT min(e.near) FROM e WHERE e.word = w.word AND e.near_n = f.most AND f.most >= 10 * w.n) AS form FROM w LEFT JOIN f USING (word)),
p AS (SELECT word, word AS root, 0 AS depth FROM g UNION ALL SELECT p.word, g.form, p.depth + 1 FROM p JOIN g ON g.word = p.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, q.root, g.n, g.n_near, g.form_n FROM g JOIN (SELECT word, arg_max(root, depth) AS root FROM p GROUP BY word) q USING (word)"""

ORACLE_SQL["op13_fill_in_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS u FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM s"""
