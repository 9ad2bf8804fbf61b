"""Registered queries of the engine, and the SQL that says the same.

The SQL is written for DuckDB over the same tables.  Its patterns and constants
come from the tables of the library, its algorithms do not.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import text as T
from ..model import Config, Model
from ..operators import clean, codec, inspect, metrics, pairs, train
from ..session import table
from ..sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The fixed model of the encoding queries is learnt from these words.
LESSON = "the then there that this and hand with in ing tion er re on an en es st de le la les des que ment eau der die das sch ein ich und ado mente ción los las " * 3
FIXED_SIZE = 320


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@lru_cache
def fixed_model() -> Model:
    """A small model that is the same everywhere."""
    counts: dict[bytes, int] = {}
    for w in LESSON.split(" "):
        counts[w.encode()] = counts.get(w.encode(), 0) + 1
    model = train.learn(counts.items(), FIXED_SIZE)
    model.config = Config(vocab_size=FIXED_SIZE)
    return model


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def fill(template: str, *parts: str) -> str:
    """``template`` with ``{0}``, ``{1}`` replaced; other braces are left alone."""
    for i, p in enumerate(parts):
        template = template.replace(f"{{{i}}}", p)
    return template


SPACE = T.char_class(T.SPACE)
# DuckDB's regular expressions want a plain form of the last alternative
_ALL = f"regexp_extract_all({{0}}, {q(T.PRETOKEN)})"
_WS = f"regexp_replace({{0}}, {q(SPACE + '+')}, ' ', 'g')"
_LOWER = f"translate({{0}}, {q(T._TO_LOWER[0])}, {q(T._TO_LOWER[1])})"
_UPPER = f"translate({{0}}, {q(T._TO_UPPER[0])}, {q(T._TO_UPPER[1])})"
_ACCENT = f"regexp_replace({{0}}, {q(T.char_class(T.ACCENT))}, '', 'g')"
_WHITE = clean.WHITE

# --- normalisation ------------------------------------------------------------


@query("normalize_ws", f"SELECT doc_id, {fill(_WS, 'text')} AS text FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.normalize(F.col("text")).alias("text"))


@query("normalize_all", f"SELECT doc_id, {fill(_WS, fill(_LOWER, fill(_ACCENT, 'text')))} AS text FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    flags = T.Norm.STRIP_ACCENTS | T.Norm.LOWERCASE | T.Norm.WHITESPACE | T.Norm.NFC
    return docs(spark, d).select("doc_id", T.normalize(F.col("text"), flags).alias("text"))


@query("strip_accents", f"SELECT doc_id, {fill(_ACCENT, 'nfd')} AS text FROM (SELECT doc_id, replace(text, 'é', 'e' || chr(769)) AS nfd FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.strip_accents(F.replace("text", F.lit("é"), F.lit("é"))).alias("text"))


@query("turkish_lower", f"SELECT doc_id, {fill(_LOWER, 'text')} AS text FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.turkish_lower(F.col("text")).alias("text"))


@query("turkish_upper", f"SELECT doc_id, {fill(_UPPER, 'text')} AS text FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.turkish_upper(F.col("text")).alias("text"))


# --- UTF-8 --------------------------------------------------------------------


@query("utf8_lengths", "SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, NOT contains(text, chr(65533)) AS valid FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return docs(spark, d).select("doc_id", F.length(text).cast("long").alias("chars"), F.octet_length(text).cast("long").alias("bytes"), T.is_clean_utf8(text).alias("valid"))


@query("utf8_sequence_lengths", "SELECT b, CASE WHEN b BETWEEN 192 AND 223 THEN 2 WHEN b BETWEEN 224 AND 239 THEN 3 WHEN b BETWEEN 240 AND 247 THEN 4 ELSE 1 END AS size FROM range(256) AS t(b)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(256).select(F.col("id").alias("b"), T.sequence_length(F.col("id")).alias("size"))


@query("utf8_malformed")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its last byte cut off and a stray one put in front, through the binary path."""
    raw = F.encode("text", "UTF-8")
    damaged = F.concat(F.lit(bytearray(b"\xc0\xaf")), F.substring(raw, F.lit(1), F.octet_length(raw) - 1))
    rows = docs(spark, d).select("doc_id", damaged.alias("data"))
    return rows.select("doc_id", T.is_clean_utf8(F.col("data")).alias("valid"), B.strlen_binary()(F.col("data")).alias("steps"), F.size(B.pretokens_binary()(F.col("data"))).alias("chunks"))


# --- chunks -------------------------------------------------------------------


@query("pretokenize", f"SELECT doc_id, (i - 1)::INTEGER AS pos, c[i] AS chunk FROM (SELECT doc_id, {fill(_ALL, 'text')} AS c FROM documents), unnest(range(1, len(c) + 1)) AS t(i)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pairs.chunks(docs(spark, d))


_CHUNKS = f"SELECT unnest({fill(_ALL, 'text')}) AS chunk FROM documents"


@query("chunk_counts", f"SELECT chunk, count(*) AS n FROM ({_CHUNKS}) GROUP BY chunk")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pairs.dictionary(docs(spark, d))


def _case(char: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({char}, {q('^' + T.char_class(r))}) THEN '{k}'" for k, r in (("letter", T.LETTER), ("digit", T.DIGIT), ("space", T.SPACE))) + " ELSE 'other' END"


@query("category_counts", f"SELECT {_case('chunk')} AS category, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars FROM ({_CHUNKS}) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    counts = pairs.dictionary(docs(spark, d)).withColumn("category", T.category(F.col("chunk")))
    return counts.groupBy("category").agg(F.sum("n").alias("chunks"), F.sum(F.col("n") * F.length("chunk")).alias("chars"))


@query("punctuation_counts", f"SELECT chunk, count(*) AS n FROM ({_CHUNKS}) WHERE regexp_matches(chunk, {q('^' + T.char_class(T.PUNCTUATION))}) GROUP BY chunk")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pairs.dictionary(docs(spark, d)).filter(T.is_punctuation(F.col("chunk")))


# --- pairs and training ---------------------------------------------------------

_DICT = f"dict AS (SELECT chunk, count(*) AS n FROM ({_CHUNKS}) GROUP BY chunk)"
_HEX = f"{_DICT}, hexed AS (SELECT hex(encode(chunk)) AS h, n FROM dict)"
_PAIRS = f"""{_HEX},
pairs AS (
  SELECT ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS left_id, ('0x' || substr(h, 2 * i + 3, 2))::INTEGER AS right_id, sum(n)::BIGINT AS n
  FROM hexed, unnest(range(0, length(h) // 2 - 1)) AS t(i) GROUP BY ALL)"""


@query("byte_pair_counts", f"WITH {_PAIRS} SELECT * FROM pairs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pairs.with_ids(pairs.pair_counts(pairs.token_strings(pairs.dictionary(docs(spark, d)))))


@query("best_pair_topk", f"WITH {_PAIRS} SELECT * FROM pairs ORDER BY n DESC, left_id, right_id LIMIT 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pairs.best_pairs(pairs.with_ids(pairs.pair_counts(pairs.token_strings(pairs.dictionary(docs(spark, d))))), 20)


FIRST = 6
#: A chunk as a string of one character per byte.
_BYTE_STRING = "array_to_string(list_transform(range(0, length(h) // 2), lambda i: chr(('0x' || substr(h, 2 * i + 1, 2))::INTEGER)), '')"


def _first_merges_sql(k: int) -> str:
    steps, out = [], []
    for i in range(k):
        steps.append(f"""p{i} AS (SELECT substr(s, j, 2) AS p, sum(n)::BIGINT AS n FROM s{i}, unnest(range(1, length(s))) AS t(j) GROUP BY 1),
m{i} AS (SELECT p, n FROM p{i} ORDER BY n DESC, ord(p[1]), ord(p[2]) LIMIT 1),
s{i + 1} AS (SELECT replace(s, (SELECT p FROM m{i}), chr({256 + i})) AS s, n FROM s{i})""")
        out.append(f"SELECT {i} AS rank, ord(p[1])::INTEGER AS left_id, ord(p[2])::INTEGER AS right_id, {256 + i} AS result_id FROM m{i}")
    return f"WITH {_HEX}, s0 AS MATERIALIZED (SELECT {_BYTE_STRING} AS s, n FROM hexed),\n" + ",\n".join(steps) + "\n" + " UNION ALL ".join(out)


@query("first_merges_distributed", _first_merges_sql(FIRST))
def _(spark: SparkSession, d: str) -> DataFrame:
    return train.train(docs(spark, d), 256 + FIRST, distributed=True).merges_frame(spark)


@query("first_merges", _first_merges_sql(FIRST))
def _(spark: SparkSession, d: str) -> DataFrame:
    return train.train(docs(spark, d), 256 + FIRST, distributed=False).merges_frame(spark)


@query("train_vocab_512")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A whole training run: the vocabulary of 512 tokens."""
    return train.train(docs(spark, d), 512).vocab_frame(spark)


# --- encoding -------------------------------------------------------------------


def _rules_sql(model: Model) -> str:
    return "[" + ", ".join(f"chr({a}) || chr({b}) || chr({c})" for a, b, c in model.merges) + "]"


def _encoded_sql(model: Model, source: str = "documents", key: str = "doc_id") -> str:
    """CTEs ending in enc(key, pos, ids): ids of each chunk by the fixed model."""
    return f"""rules AS (SELECT {_rules_sql(model)} AS r),
chunks AS (SELECT {key}, i AS pos, c[i] AS chunk FROM (SELECT {key}, {fill(_ALL, fill(_WS, 'text'))} AS c FROM {source}), unnest(range(1, len(c) + 1)) AS t(i)),
words AS (SELECT chunk, hex(encode(chunk)) AS h FROM (SELECT DISTINCT chunk FROM chunks)),
folded AS (SELECT chunk, list_reduce(list_prepend({_BYTE_STRING}, r), lambda a, m: replace(a, m[1:2], m[3])) AS s FROM words, rules),
coded AS (SELECT chunk, list_transform(range(1, length(s) + 1), lambda i: ord(s[i])::INTEGER) AS ids FROM folded),
enc AS (SELECT {key}, pos, ids FROM chunks JOIN coded USING (chunk))"""


_ENC = _encoded_sql(fixed_model())
_IDS = "SELECT doc_id, array_to_string(flatten(list(ids ORDER BY pos)), ' ') AS ids FROM enc GROUP BY doc_id"


def _joined(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query("bpe_encode", f"WITH {_ENC} {_IDS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _joined(codec.encode(docs(spark, d), fixed_model()))


@query("bpe_encode_native", f"WITH {_ENC} {_IDS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _joined(codec.encode_native(docs(spark, d), fixed_model()))


@query("bpe_encode_conversations", f"WITH {_encoded_sql(fixed_model(), '(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)')} {_IDS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return _joined(codec.encode(rows, fixed_model()))


@query("token_counts", f"WITH {_ENC} SELECT id, count(*) AS n FROM (SELECT unnest(ids) AS id FROM enc) GROUP BY id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return codec.encode(docs(spark, d), fixed_model()).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))


@query("bpe_decode_roundtrip", f"SELECT doc_id, {fill(_WS, 'text')} AS text FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    back = codec.decode(codec.encode(docs(spark, d), fixed_model()), fixed_model())
    return back.select("doc_id", F.decode("bytes", "UTF-8").alias("text"))


@query("binary_roundtrip", "SELECT page_id AS doc_id, md5(html) AS digest FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Raw bytes, without normalisation, there and back."""
    rows = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.encode("html", "UTF-8").alias("text"))
    return codec.decode(codec.encode(rows, fixed_model(), raw=True), fixed_model()).select("doc_id", F.md5("bytes").alias("digest"))


@query("parse_ids", r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[+-]?[0-9]+'), lambda x: x::BIGINT), ',') AS ids FROM (SELECT doc_id, doc_id || ' ' || (doc_id * 7) || ',x' || n_chars || ' -5' AS text FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id"), F.lit(" "), F.col("doc_id") * 7, F.lit(",x"), F.col("n_chars"), F.lit(" -5")).alias("text"))
    return rows.select("doc_id", files.id_text(files.parse_ids(F.col("text")), ",").alias("ids"))


# --- the model as tables --------------------------------------------------------


def _vocab_sql(model: Model) -> str:
    return "vocab(id, len, bytes) AS (VALUES " + ", ".join(f"({i}, {len(t)}, unhex('{t.hex()}'))" for i, t in enumerate(model.tokens)) + ")"


def _merges_sql(model: Model) -> str:
    return "merges(rank, left_id, right_id, result_id) AS (VALUES " + ", ".join(f"({r}, {a}, {b}, {c})" for r, (a, b, c) in enumerate(model.merges)) + ")"


_SHOWN = r"""(SELECT string_agg(CASE WHEN x = '22' THEN '\"' WHEN x = '5C' THEN '\\' WHEN x = '0A' THEN '\n' WHEN x = '09' THEN '\t' WHEN x = '0D' THEN '\r' WHEN x = '20' THEN '·'
  WHEN ('0x' || x)::INTEGER BETWEEN 32 AND 126 THEN chr(('0x' || x)::INTEGER) ELSE '\x' || x END, '' ORDER BY j)
  FROM (SELECT j, substr(hex({0}), 2 * j + 1, 2) AS x FROM unnest(range(0, length(hex({0})) // 2)) AS t(j)))"""


def _vocab(spark: SparkSession) -> DataFrame:
    return fixed_model().vocab_frame(spark)


@query("vocab_summary", f"WITH {_vocab_sql(fixed_model())}, {_merges_sql(fixed_model())} SELECT (SELECT count(*) FROM vocab) AS vocab_size, (SELECT count(*) FROM merges) AS num_merges, 256 AS base_tokens, (SELECT count(*) FROM vocab) - 256 AS merged_tokens")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inspect.summary(_vocab(spark), fixed_model().merges_frame(spark))


@query("vocab_length_histogram", f"WITH {_vocab_sql(fixed_model())}, c AS (SELECT len, count(*) AS n FROM vocab GROUP BY len) SELECT len, n, repeat('#', (n * 40 // (SELECT max(n) FROM c))::INTEGER) AS bar FROM c WHERE len BETWEEN 1 AND 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inspect.length_histogram(_vocab(spark))


@query("merge_listing", f"WITH {_vocab_sql(fixed_model())}, {_merges_sql(fixed_model())}, shown AS (SELECT id, {fill(_SHOWN, 'bytes')} AS s FROM vocab) SELECT rank, left_id, right_id, result_id, a.s AS \"left\", b.s AS \"right\", c.s AS result FROM merges JOIN shown a ON a.id = left_id JOIN shown b ON b.id = right_id JOIN shown c ON c.id = result_id WHERE rank < 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inspect.merge_listing(_vocab(spark), fixed_model().merges_frame(spark))


@query("merged_tokens", f"WITH {_vocab_sql(fixed_model())} SELECT id, len, {fill(_SHOWN, 'bytes')} AS token FROM vocab WHERE id BETWEEN 256 AND 305")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inspect.merged_tokens(_vocab(spark))


@query("vocab_search", f"WITH {_vocab_sql(fixed_model())} SELECT id, len, {fill(_SHOWN, 'bytes')} AS token FROM vocab WHERE contains(hex(bytes), hex(encode('en')))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inspect.search(_vocab(spark), b"en")


@query("vocab_dump", f"WITH {_vocab_sql(fixed_model())} SELECT id, len, {fill(_SHOWN, 'bytes')} AS token FROM vocab")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inspect.dump(_vocab(spark))


@query("vocab_lookup", f"WITH {_vocab_sql(fixed_model())}, {_DICT} SELECT chunk, n, coalesce(id, -1) AS id FROM dict LEFT JOIN vocab ON vocab.bytes = encode(chunk)")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = pairs.dictionary(docs(spark, d)).withColumn("bytes", F.encode("chunk", "UTF-8"))
    return inspect.lookup(words, _vocab(spark)).select("chunk", "n", F.coalesce("id", F.lit(-1)).alias("id"))


# --- cleaning -------------------------------------------------------------------

_LINES = r"lines AS (SELECT doc_id, (i - 1)::INTEGER AS line_no, ls[i] AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i))"
_STRIP = f"regexp_replace({{0}}, {q(f'^{_WHITE}+|{_WHITE}+$')}, '', 'g')"
_CLEAN = f"nfc_normalize({fill(_STRIP, r'''regexp_replace(regexp_replace(regexp_replace(line, '[\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '[\x{0}-\x{8}\x{B}-\x{1F}\x{7F}-\x{9F}\x{AD}]', '', 'g'), '[ \t]+', ' ', 'g')''')})"
_CLEANED = f"{_LINES}, cleaned AS (SELECT doc_id, line_no, {_CLEAN} AS clean FROM lines)"
_STOP = "[" + ", ".join(q(w) for w in clean.STOPWORDS) + "]"
_SCORED = f"""{_CLEANED}, parts AS (
  SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(clean), {q(_WHITE + '+')}), lambda w: w <> '')) AS ws,
    length(regexp_replace(clean, '\\P{{L}}', '', 'g')) AS letters, length(regexp_replace(clean, {q(f'[^{clean.ALPHABET}]')}, '', 'g')) AS known
  FROM cleaned),
scored AS (
  SELECT *, CASE WHEN len(ws) = 0 THEN 0 ELSE (CASE WHEN regexp_matches(clean, {q(f'[{clean.SPECIFIC}]')}) THEN 0.4::DOUBLE ELSE 0 END) + (CASE WHEN letters > 0 THEN known::DOUBLE / letters ELSE 0 END) * 0.3::DOUBLE
    + least(len(list_intersect(ws, {_STOP}))::DOUBLE / greatest(len(ws), 1) * 2, 0.3::DOUBLE) END AS score
  FROM parts),
first_fail AS (
  SELECT *, CASE WHEN length(clean) < 20 THEN 'too_short' WHEN length(clean) > 10000 THEN 'too_long' WHEN NOT score >= 0.3::DOUBLE THEN 'not_turkish' ELSE 'kept' END AS s0 FROM scored),
judged AS (
  SELECT doc_id, line_no, clean, CASE WHEN s0 = 'kept' AND row_number() OVER (PARTITION BY s0, CASE WHEN s0 = 'kept' THEN md5(clean) END ORDER BY doc_id, line_no) > 1 THEN 'duplicate' ELSE s0 END AS status FROM first_fail)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return clean.lines(docs(spark, d))


@query("clean_lines", f"WITH {_CLEANED} SELECT * FROM cleaned")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "line_no", clean.clean(F.col("line")).alias("clean"))


@query("length_filter", f"WITH {_CLEANED} SELECT * FROM cleaned WHERE length(clean) BETWEEN 20 AND 10000")
def _(spark: SparkSession, d: str) -> DataFrame:
    return clean.kept(_lines(spark, d), turkish=False, dedup=False)


@query("language_score", f"WITH {_SCORED} SELECT doc_id, line_no, round(score, 6) AS score, score >= 0.3::DOUBLE AS turkish FROM scored")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.scored(_lines(spark, d))
    return rows.select("doc_id", "line_no", F.round("score", 6).alias("score"), (F.col("score") >= F.lit(clean.THRESHOLD)).alias("turkish"))


@query("preprocess_status", f"WITH {_SCORED} SELECT * FROM judged")
def _(spark: SparkSession, d: str) -> DataFrame:
    return clean.judged(_lines(spark, d))


@query("preprocess_kept", f"WITH {_SCORED} SELECT doc_id, line_no, clean FROM judged WHERE status = 'kept'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return clean.kept(_lines(spark, d))


@query("preprocess_summary", f"WITH {_SCORED} SELECT count(*) AS total, {', '.join(f'''count(*) FILTER (status = '{s}') AS {s}''' for s in ('kept', 'too_short', 'too_long', 'not_turkish', 'duplicate'))}, round(count(*) FILTER (status = 'kept') * 100.0 / greatest(count(*), 1), 6)::DOUBLE AS kept_percent FROM judged")
def _(spark: SparkSession, d: str) -> DataFrame:
    return clean.summary(clean.judged(_lines(spark, d)))


@query("preprocess_sample", f"WITH {_CLEANED} SELECT doc_id, line_no, clean FROM cleaned WHERE length(clean) BETWEEN 20 AND 10000 AND (doc_id, line_no) IN (SELECT (doc_id, line_no) FROM lines ORDER BY doc_id, line_no LIMIT 100)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The sampling option: the first 100 lines, before all rules."""
    return clean.kept(_lines(spark, d), sample=100, turkish=False, dedup=False)


@query("exact_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def _(spark: SparkSession, d: str) -> DataFrame:
    return clean.first_texts(docs(spark, d))


@query("web_documents", f"SELECT doc_id, {fill(_STRIP, 'text')} AS text FROM documents WHERE {fill(_STRIP, 'text')} <> ''")
def _(spark: SparkSession, d: str) -> DataFrame:
    return files.web_documents(docs(spark, d)).select("doc_id", "text")


@query("wiki_lines", f"WITH {_LINES} SELECT doc_id, line_no, line FROM lines WHERE NOT contains(line, '<doc ') AND NOT contains(line, '</doc>') AND {fill(_STRIP, 'line')} <> ''")
def _(spark: SparkSession, d: str) -> DataFrame:
    return files.wiki_lines(_lines(spark, d))


# --- metrics --------------------------------------------------------------------

_TOTALS = f"""tokens AS (SELECT doc_id, sum(len(ids))::BIGINT AS n FROM enc GROUP BY doc_id),
rows AS (SELECT lang, text, n FROM documents JOIN tokens USING (doc_id)),
t AS (SELECT {{0}} sum(n)::BIGINT AS total_tokens, sum(length(text))::BIGINT AS total_chars, sum(strlen(text))::BIGINT AS total_bytes,
  sum(len(list_filter(regexp_split_to_array(text, {q(_WHITE + '+')}), lambda w: w <> '')))::BIGINT AS total_words FROM rows {{1}})"""
_RATIOS = "total_tokens, total_chars, total_bytes, total_words, total_tokens::DOUBLE / greatest(total_chars, 1) AS tokens_per_char, total_tokens::DOUBLE / greatest(total_words, 1) AS tokens_per_word, total_bytes::DOUBLE / greatest(total_tokens, 1) AS bytes_per_token, total_chars::DOUBLE / greatest(total_tokens, 1) AS chars_per_token"


def _measured(spark: SparkSession, d: str, model: Model | None = None) -> DataFrame:
    rows = docs(spark, d)
    return rows.select("lang", "text", codec.encode_udf(model or fixed_model(), rows)(T.normalize(F.col("text"))).alias("ids"))


@query("fertility", f"WITH {_ENC}, {fill(_TOTALS, '', '')} SELECT {_RATIOS} FROM t")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fertility(_measured(spark, d))


@query("fertility_by_lang", f"WITH {_ENC}, {fill(_TOTALS, 'lang,', 'GROUP BY lang')} SELECT lang, {_RATIOS} FROM t")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fertility(_measured(spark, d), ["lang"])


@query("compression_verdict", f"WITH {_ENC}, {fill(_TOTALS, 'lang,', 'GROUP BY lang')} SELECT lang, CASE WHEN r < 1.5 THEN 'excellent' WHEN r < 2 THEN 'good' WHEN r < 3 THEN 'moderate' ELSE 'poor' END AS verdict, u AS unknown_rate FROM (SELECT lang, total_tokens::DOUBLE / greatest(total_words, 1) AS r, total_tokens::DOUBLE / greatest(total_bytes, 1) AS u FROM t)")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = metrics.unknown_rate(metrics.fertility(_measured(spark, d), ["lang"]))
    return t.select("lang", metrics.verdict(F.col("tokens_per_word")).alias("verdict"), "unknown_rate")


@query("compare_models")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The fixed model against plain bytes."""
    return metrics.compare(metrics.fertility(_measured(spark, d)), metrics.fertility(_measured(spark, d, Model())))


def _words(spark: SparkSession, model: Model) -> DataFrame:
    rows = spark.createDataFrame([(w,) for w in metrics.WORDS], "text string")
    return metrics.word_analysis(rows.select("text", codec.encode_udf(model, rows)(F.col("text")).alias("ids")))


@query("word_analysis", f"WITH words_in AS (SELECT unnest([{', '.join(q(w) for w in metrics.WORDS)}]) AS text), source AS (SELECT text AS doc_id, text FROM words_in), {_encoded_sql(fixed_model(), 'source')} SELECT doc_id AS text, sum(len(ids))::INTEGER AS n_tokens, strlen(doc_id)::INTEGER AS n_bytes, strlen(doc_id)::DOUBLE / greatest(sum(len(ids)), 1) AS bytes_per_token FROM enc GROUP BY doc_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, fixed_model())


@query("compare_words")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.compare_words(_words(spark, fixed_model()), _words(spark, Model()))
