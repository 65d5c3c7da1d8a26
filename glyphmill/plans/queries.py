"""Queries of the engine's own operators over the tables, each with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..core.decoders import decoder
from ..core.normalizers import normalizer
from ..core.postprocess import post_processor
from ..core.pretokenizers import GPT2, pre_tokenizer
from ..sources.texts import spread
from . import toys, wordlevel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


TEXTS = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"
#: Classes as DuckDB spells them.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NWS = WS.replace("[", "[^", 1)
WORD = r"\p{L}\p{M}\p{N}_"


def _normalized(name: str, config: dict, sql: str) -> None:
    """A normalizer over all documents: its text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return texts(spark, sf_dir).select("doc_id", normalizer(config).column(F.col("text")).alias("normalized"))

    QUERIES[name] = query
    ORACLES[name] = f"SELECT doc_id, {sql} AS normalized FROM {TEXTS}"


def _pieced(name: str, config: dict, sql: str, source: str = TEXTS) -> None:
    """A pre-tokenizer over all documents: how many pieces, and a digest of them in order."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pieces = texts(spark, sf_dir).select("doc_id", F.filter(pre_tokenizer(config).column(F.col("text")), lambda p: p != "").alias("p"))
        return pieces.select("doc_id", F.size("p").cast("bigint").alias("n_pieces"), F.md5(F.encode(F.array_join("p", "\x01"), "UTF-8")).alias("digest"))

    QUERIES[name] = query
    ORACLES[name] = f"SELECT doc_id, len(p)::BIGINT AS n_pieces, md5(array_to_string(p, chr(1))) AS digest FROM (SELECT doc_id, list_filter({sql}, lambda x: x <> '') AS p FROM {source})"


def _extract(pattern: str) -> str:
    return f"regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}')"


# --- normalizers ---

_normalized("norm_identity", {"type": "Sequence", "normalizers": []}, "text")
_normalized("norm_prepend", {"type": "Prepend", "prepend": "▁"}, "CASE WHEN text <> '' THEN '▁' || text ELSE text END")
_normalized("norm_replace_literal", {"type": "Replace", "pattern": {"String": "th"}, "content": "[$1]"}, "replace(text, 'th', '[$1]')")
_normalized("norm_replace_regex", {"type": "Replace", "pattern": {"Regex": " {2,}|e+r"}, "content": "_"}, "regexp_replace(text, ' {2,}|e+r', '_', 'g')")
_normalized("norm_lowercase", {"type": "Lowercase"}, "lower(text)")
_normalized("norm_strip_accents", {"type": "StripAccents"}, r"regexp_replace(text, '\p{M}', '', 'g')")
_normalized("norm_strip", {"type": "Strip"}, rf"regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '')")
_normalized("norm_nmt", {"type": "Nmt"}, r"regexp_replace(regexp_replace(text, '[\x{1}-\x{8}\x{B}\x{E}-\x{1F}\x{7F}\x{8F}\x{9F}]', '', 'g'), '[\x{9}\x{A}\x{C}\x{D}\x{1680}\x{200B}-\x{200F}\x{2028}\x{2029}\x{2581}\x{FEFF}\x{FFFD}]', ' ', 'g')")
_normalized(
    "norm_bert_uncased_keep_accents",
    {"type": "BertNormalizer", "strip_accents": False},
    rf"lower(regexp_replace(regexp_replace(regexp_replace(text, '[\x{{0}}-\x{{8}}\x{{B}}\x{{C}}\x{{E}}-\x{{1F}}\x{{7F}}-\x{{9F}}\p{{Cf}}\p{{Co}}\x{{FFFD}}]', '', 'g'), '{WS}', ' ', 'g'), '([\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{F900}}-\x{{FAFF}}])', ' \1 ', 'g'))",
)
_normalized("norm_metaspace_always", {"type": "MetaspaceNormalizer", "replacement": "▁", "prepend": "always", "drop_whitespace": False}, "CASE WHEN text = '' THEN '' WHEN starts_with(replace(text, ' ', '▁'), '▁') THEN replace(text, ' ', '▁') ELSE '▁' || replace(text, ' ', '▁') END")
_normalized("norm_metaspace_drop", {"type": "MetaspaceNormalizer", "replacement": "▁", "prepend": "always", "drop_whitespace": True}, rf"array_to_string(list_transform(regexp_extract_all(text, '{NWS}+'), lambda w: CASE WHEN starts_with(w, '▁') THEN w ELSE '▁' || w END), '')")
_normalized("norm_sequence", {"type": "Sequence", "normalizers": [{"type": "Strip"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"String": " "}, "content": "▁"}]}, rf"replace(lower(regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '')), ' ', '▁')")


def _byte_level_sql(text: str) -> str:
    """Bytes above 0x7E are two-byte letters in these tables: each byte of the hexadecimal form by a list of the alphabet."""
    return f"array_to_string(list_transform(range(0, octet_length(encode({text}))), lambda i: list_extract(a, ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::INT + 1)), '')"


ALPHABET = """WITH alphabet AS (SELECT list(c ORDER BY b) AS a FROM (
  SELECT b, CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 THEN chr(b::INT)
  ELSE chr((256 + CASE WHEN b < 33 THEN b WHEN b = 173 THEN 67 ELSE b - 127 + 33 END)::INT) END AS c FROM range(0, 256) t(b)))"""


def norm_byte_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte alphabet of part names."""
    return table(spark, sf_dir, "part").select("p_partkey", normalizer({"type": "ByteLevel"}).column(F.col("p_name")).alias("normalized"))


QUERIES["norm_byte_level"] = norm_byte_level
ORACLES["norm_byte_level"] = f"{ALPHABET} SELECT p_partkey, {_byte_level_sql('p_name')} AS normalized FROM part, alphabet"


def norm_byte_level_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte alphabet of all documents, as whole texts: part names are ASCII, so norm_byte_level meets few bytes."""
    return texts(spark, sf_dir).select("doc_id", normalizer({"type": "ByteLevel"}).column(F.col("text")).alias("normalized"))


QUERIES["norm_byte_level_documents"] = norm_byte_level_documents
#: As for part names, but the hexadecimal form is cut once, so the time is linear in the text.
ORACLES["norm_byte_level_documents"] = f"{ALPHABET} SELECT doc_id, array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: list_extract(a, ('0x' || h)::INT + 1)), '') AS normalized FROM {TEXTS}, alphabet"

# --- pre-tokenizers ---

_pieced("pre_whitespace", {"type": "Whitespace"}, _extract(rf"[{WORD}]+|[^{WORD}\s]+"))
_pieced("pre_whitespace_split", {"type": "WhitespaceSplit"}, _extract(rf"{NWS}+"))
_pieced("pre_bert", {"type": "BertPreTokenizer"}, _extract(r"[\p{P}$+<=>^`|~]|[^\p{P}$+<=>^`|~\s]+"))
_pieced("pre_punctuation", {"type": "Punctuation"}, _extract(r"[\p{P}$+<=>^`|~]|[^\p{P}$+<=>^`|~]+"))
_pieced("pre_punctuation_removed", {"type": "Punctuation", "behavior": "Removed"}, _extract(r"[^\p{P}$+<=>^`|~]+"))
_pieced("pre_punctuation_contiguous", {"type": "Punctuation", "behavior": "Contiguous"}, _extract(r"[\p{P}$+<=>^`|~]+|[^\p{P}$+<=>^`|~]+"))
_pieced("pre_digits", {"type": "Digits", "individual_digits": False}, _extract(r"\p{N}+|\P{N}+"))
_pieced("pre_digits_individual", {"type": "Digits", "individual_digits": True}, _extract(r"\p{N}|\P{N}+"))
_pieced("pre_split_regex_removed", {"type": "Split", "pattern": {"Regex": r"[.,]\s*"}, "behavior": "Removed"}, r"regexp_split_to_array(text, '[.,]\s*')")
_pieced("pre_split_regex_isolated", {"type": "Split", "pattern": {"Regex": "[0-9]{3}"}, "behavior": "Isolated"}, "string_split(regexp_replace(text, '([0-9]{3})', chr(2) || '\\1' || chr(2), 'g'), chr(2))")
_pieced("pre_split_literal_removed", {"type": "Split", "pattern": {"String": "the"}, "behavior": "Removed"}, "string_split(text, 'the')")
_pieced("pre_split_inverted", {"type": "Split", "pattern": {"Regex": r"\p{L}+"}, "behavior": "Removed", "invert": True}, _extract(r"\p{L}+"))
_pieced("pre_char_delimiter", {"type": "CharDelimiterSplit", "delimiter": "e"}, "string_split(text, 'e')")
_pieced("pre_fixed_length", {"type": "FixedLength", "length": 7}, _extract("(?s).{1,7}"))
_pieced("pre_metaspace", {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always"}, "regexp_extract_all(CASE WHEN starts_with(replace(text, ' ', '▁'), '▁') THEN replace(text, ' ', '▁') ELSE '▁' || replace(text, ' ', '▁') END, '▁?[^▁]+|▁')")
_pieced("pre_metaspace_never_whole", {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "never", "split": False}, "[replace(text, ' ', '▁')]")
_pieced("pre_sequence", {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Digits", "individual_digits": True}]}, rf"flatten(list_transform(regexp_extract_all(text, '{NWS}+'), lambda w: regexp_extract_all(w, '\p{{N}}|\P{{N}}+')))")
#: RE2 has no lookahead: a mark is put where a run of white space gives its last one to what follows, and taken out again.
_pieced(
    "pre_gpt2_pattern",
    {"type": "Split", "pattern": {"Regex": GPT2}, "behavior": "Isolated"},
    r"list_filter(regexp_extract_all(regexp_replace(text, '(\s+)(\s\S)', '\1' || chr(1) || '\2', 'g'), chr(1) || '|''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}' || chr(1) || ']+|\s+'), lambda x: x <> chr(1))",
)

# --- models, as relational plans ---

LOWER = {"type": "Lowercase"}
WHITESPACE = {"type": "Whitespace"}
VOCABULARY = 1000
PIECES_SQL = rf"""pieces AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS piece FROM (
  SELECT doc_id, regexp_extract_all(lower(text), '[{WORD}]+|[^{WORD}\s]+') AS p FROM {TEXTS}))"""
VOCAB_SQL = f"""vocab AS (SELECT row_number() OVER (ORDER BY n DESC, piece) AS id, piece FROM (
  SELECT piece, count(*) AS n FROM pieces GROUP BY piece ORDER BY n DESC, piece LIMIT {VOCABULARY}))"""


def _wordlevel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = wordlevel.pieces(texts(spark, sf_dir), "doc_id", "text", LOWER, WHITESPACE)
    return rows, wordlevel.frequent(rows, VOCABULARY)


def model_wordlevel_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: lower case, white space and punctuation, ids of the most frequent pieces, one row a token."""
    rows, vocabulary = _wordlevel(spark, sf_dir)
    return wordlevel.encode(rows, vocabulary).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("id").cast("bigint").alias("id"))


def model_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary itself."""
    return _wordlevel(spark, sf_dir)[1].select(F.col("id").cast("bigint").alias("id"), "piece")


def model_fuse_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with runs of unknown ones fused, as a count and a digest a document."""
    rows, vocabulary = _wordlevel(spark, sf_dir)
    ids = wordlevel.encode(rows, vocabulary).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    fused = F.filter("ids", lambda x, i: ~((x == 0) & (i > 0) & (F.get(F.col("ids"), i - 1) == 0)))
    return ids.select("doc_id", F.size(fused).cast("bigint").alias("n"), F.md5(F.encode(F.array_join(fused.cast("array<string>"), ","), "UTF-8")).alias("digest"))


def decode_wordlevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known ids back into text."""
    rows, vocabulary = _wordlevel(spark, sf_dir)
    return wordlevel.decode(wordlevel.encode(rows, vocabulary).drop("piece"), vocabulary, "doc_id")


def oov_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each piece outside the vocabulary occurs."""
    rows, vocabulary = _wordlevel(spark, sf_dir)
    return rows.join(F.broadcast(vocabulary), "piece", "left_anti").groupBy("piece").agg(F.count("*").alias("n"))


for f in (model_wordlevel_encode, model_vocabulary, model_fuse_unknown, decode_wordlevel, oov_pieces):
    QUERIES[f.__name__] = f
ORACLES["model_wordlevel_encode"] = f"WITH {PIECES_SQL}, {VOCAB_SQL} SELECT doc_id, pos::BIGINT AS pos, coalesce(id, 0)::BIGINT AS id FROM pieces LEFT JOIN vocab USING (piece)"
ORACLES["model_vocabulary"] = f"WITH {PIECES_SQL}, {VOCAB_SQL} SELECT id::BIGINT AS id, piece FROM vocab"
ORACLES["model_fuse_unknown"] = f"""WITH {PIECES_SQL}, {VOCAB_SQL},
 ids AS (SELECT doc_id, pos, coalesce(id, 0) AS id FROM pieces LEFT JOIN vocab USING (piece)),
 marked AS (SELECT *, lag(id) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM ids)
 SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg(id::VARCHAR, ',' ORDER BY pos)) AS digest FROM marked WHERE NOT (id = 0 AND coalesce(before, -1) = 0) GROUP BY doc_id"""
ORACLES["decode_wordlevel"] = f"WITH {PIECES_SQL}, {VOCAB_SQL} SELECT doc_id, string_agg(piece, ' ' ORDER BY pos) AS text FROM pieces JOIN vocab USING (piece) GROUP BY doc_id"
ORACLES["oov_pieces"] = f"WITH {PIECES_SQL}, {VOCAB_SQL} SELECT piece, count(*) AS n FROM pieces WHERE piece NOT IN (SELECT piece FROM vocab) GROUP BY piece"

# --- post-processors, truncation ---

BERT = {"type": "BertProcessing", "cls": ["[CLS]", 101], "sep": ["[SEP]", 102]}
ROBERTA = {"type": "RobertaProcessing", "cls": ["<s>", 0], "sep": ["</s>", 2]}
TEMPLATE = {
    "type": "TemplateProcessing",
    "single": [{"ids": [7, 8]}, {"seq": "A"}, {"ids": [9]}, {"seq": "A"}],
    "pair": [{"seq": "A", "type_id": 0}, {"ids": [9], "type_id": 0}, {"seq": "B", "type_id": 1}],
}


def _lengths(df: DataFrame) -> DataFrame:
    """ids: the lengths of the words of a text, as stand-ins for token ids."""
    words = F.regexp_extract_all("text", F.lit(r"\P{IsWhite_Space}+"), F.lit(0))
    return df.select("doc_id", F.transform(words, F.length).alias("ids"))


LENGTHS = rf"(SELECT doc_id, list_transform(regexp_extract_all(text, '{NWS}+'), lambda w: length(w)) AS ids FROM {TEXTS})"


def _digested(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("doc_id", *[F.md5(F.encode(F.array_join(c.cast("array<string>"), ","), "UTF-8")).alias(n) for n, c in columns.items()])


def _processed(name: str, config: dict | None, single: str, pair: str | None, types: str | None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        post = post_processor(config)
        columns = {"single": post.column(F.col("ids"))}
        if pair:
            columns["pair"], columns["types"] = post.pair_column(F.col("ids"), F.slice("ids", 1, 3))
        return _digested(_lengths(texts(spark, sf_dir)), **columns)

    digest = "md5(array_to_string({}, ','))".format
    QUERIES[name] = query
    more = f", {digest(pair)} AS pair, {digest(types)} AS types" if pair else ""
    ORACLES[name] = f"SELECT doc_id, {digest(single)} AS single{more} FROM {LENGTHS}"


def _repeat(value: int, n: str) -> str:
    return f"list_transform(range(0, {n}), lambda i: {value})"


_processed("post_bert", BERT, "[101] || ids || [102]", "[101] || ids || [102] || ids[1:3] || [102]", f"{_repeat(0, 'len(ids) + 2')} || {_repeat(1, 'len(ids[1:3]) + 1')}")
_processed("post_roberta", ROBERTA, "[0] || ids || [2]", "[0] || ids || [2, 2] || ids[1:3] || [2]", _repeat(0, "len(ids) + len(ids[1:3]) + 4"))
_processed("post_template", TEMPLATE, "[7, 8] || ids || [9] || ids", "ids || [9] || ids[1:3]", f"{_repeat(0, 'len(ids) + 1')} || {_repeat(1, 'len(ids[1:3])')}")
_processed("post_none", None, "ids", "ids || ids[1:3]", f"{_repeat(0, 'len(ids)')} || {_repeat(1, 'len(ids[1:3])')}")
_processed("post_sequence", {"type": "Sequence", "processors": [{"type": "ByteLevel"}, BERT]}, "[101] || ids || [102]", "[101] || ids || [102] || ids[1:3] || [102]", f"{_repeat(0, 'len(ids) + 2')} || {_repeat(1, 'len(ids[1:3]) + 1')}")


def truncate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten ids from either side."""
    from ..functions.columns import TokenizerFunctions

    return _digested(_lengths(texts(spark, sf_dir)), first=TokenizerFunctions.truncate(F.col("ids"), 10), last=TokenizerFunctions.truncate(F.col("ids"), 10, "left"))


QUERIES["truncate_ids"] = truncate_ids
ORACLES["truncate_ids"] = f"SELECT doc_id, md5(array_to_string(ids[1:10], ',')) AS first, md5(array_to_string(list_slice(ids, greatest(len(ids) - 9, 1), len(ids)), ',')) AS last FROM {LENGTHS}"

# --- decoders ---

WORDS = rf"(SELECT doc_id, regexp_extract_all(text, '{NWS}+') AS w FROM {TEXTS})"


def _decoded(name: str, config: dict, sql: str) -> None:
    """A decoder over the words of each document as its tokens."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = texts(spark, sf_dir).select("doc_id", F.regexp_extract_all("text", F.lit(r"\P{IsWhite_Space}+"), F.lit(0)).alias("w"))
        return words.select("doc_id", F.md5(F.encode(F.array_join(decoder(config).column(F.col("w")), ""), "UTF-8")).alias("digest"))

    QUERIES[name] = query
    ORACLES[name] = f"SELECT doc_id, md5({sql}) AS digest FROM {WORDS}"


def _joined(each: str) -> str:
    return f"array_to_string(list_transform(w, lambda t, i: {each}), '')"


_decoded("decode_fuse", {"type": "Fuse"}, "array_to_string(w, '')")
_decoded("decode_replace", {"type": "Replace", "pattern": {"String": "e"}, "content": " "}, _joined("replace(t, 'e', ' ')"))
_decoded("decode_metaspace", {"type": "Metaspace", "replacement": "n", "prepend_scheme": "always"}, _joined("replace(t, 'n', CASE WHEN i = 1 THEN '' ELSE ' ' END)"))
_decoded("decode_wordpiece", {"type": "WordPiece", "prefix": "th"}, _joined("CASE WHEN i = 1 THEN t WHEN starts_with(t, 'th') THEN substr(t, 3) ELSE ' ' || t END"))
_decoded("decode_bpe_suffix", {"type": "BPEDecoder", "suffix": "."}, "array_to_string(list_transform(w, lambda t, i: replace(t, '.', CASE WHEN i = len(w) THEN '' ELSE ' ' END)), '')")
_decoded("decode_strip", {"type": "Strip", "content": "t", "start": 1, "stop": 0}, _joined("regexp_replace(t, '^t', '')"))
_decoded("decode_ctc", {"type": "CTC", "pad_token": "<pad>", "word_delimiter_token": "|", "cleanup": False}, "array_to_string(list_filter(list_transform(w, lambda t, i: CASE WHEN i > 1 AND w[i - 1] = t THEN '' ELSE t END), lambda t: t <> ''), '')")
_decoded("decode_sequence", {"type": "Sequence", "decoders": [{"type": "Replace", "pattern": {"String": "a"}, "content": "o"}, {"type": "Fuse"}]}, "replace(array_to_string(w, ''), 'a', 'o')")


def decode_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean-up of spaced punctuation."""
    from ..core.decoders import clean_up_column

    spaced = F.regexp_replace("text", "([.,!?'])", " $1")
    return texts(spark, sf_dir).select("doc_id", F.md5(F.encode(clean_up_column(spaced), "UTF-8")).alias("digest"))


def _cleanup_sql() -> str:
    """The published rules in groups: no rule makes a match of an earlier one."""
    sql = r"regexp_replace(text, '([.,!?''])', ' \1', 'g')"
    sql = rf"regexp_replace({sql}, ' ([.?!,])', '\1', 'g')"
    sql = f"replace({sql}, ' '' ', '''')"
    for part in ("n''t", "''m", "''s", "''ve", "''re"):
        sql = f"replace({sql}, ' {part}', '{part}')"
    return sql


QUERIES["decode_cleanup"] = decode_cleanup
ORACLES["decode_cleanup"] = f"SELECT doc_id, md5({_cleanup_sql()}) AS digest FROM {TEXTS}"


def byte_level_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to the alphabet and back: the text itself."""
    pieces = pre_tokenizer({"type": "ByteLevel", "use_regex": True}).column(F.col("text"))
    back = decoder({"type": "ByteLevel"}).column(pieces)
    return texts(spark, sf_dir).select("doc_id", F.array_join(back, "").alias("text"))


QUERIES["byte_level_round_trip"] = byte_level_round_trip
ORACLES["byte_level_round_trip"] = f"SELECT doc_id, text FROM {TEXTS}"


# --- the whole engine, in vectorized Python ---


def _functions(spark: SparkSession, data: dict, config: dict | None = None):
    from ..core.tokenizer import Tokenizer
    from ..functions.columns import TokenizerFunctions

    return TokenizerFunctions(spark, Tokenizer(data, config))


def _digest(c: Column) -> Column:
    return F.md5(F.encode(F.array_join(c.cast("array<string>"), ","), "UTF-8"))


def _encoded(name: str, toy: str) -> None:
    """Ids of all documents by a toy tokenizer, as a count and a digest."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = texts(spark, sf_dir).select("doc_id", _functions(spark, getattr(toys, toy)()).encode(F.col("text")).alias("ids"))
        return made.select("doc_id", F.size("ids").cast("bigint").alias("n"), _digest(F.col("ids")).alias("digest"))

    QUERIES[name] = query


for name in ("word_piece", "bpe", "byte_bpe", "unigram"):
    _encoded(f"model_{name}_encode", name)


def model_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token strings of the scalar BPE."""
    made = texts(spark, sf_dir).select("doc_id", _functions(spark, toys.bpe()).tokenize(F.col("text")).alias("t"))
    return made.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.encode(F.array_join("t", "\x01"), "UTF-8")).alias("digest"))


def _bpe_sql() -> str:
    """Each merge once, in rank order: equal to the lowest rank first for lists like that of the toy."""
    low, high = "chr(2)", "chr(3)"
    sql = f"regexp_replace(lower(text), '({NWS})', {low} || '\\1' || {high}, 'g')"
    sql = f"regexp_replace({sql}, {low} || '[^{toys.LETTERS}]' || {high}, {low} || '<unk>' || {high}, 'g')"
    for a, b in toys._merges():
        sql = f"replace({sql}, {low} || '{a}' || {high} || {low} || '{b}' || {high}, {low} || '{a}{b}' || {high})"
    return f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, chr(1))) AS digest FROM (SELECT doc_id, regexp_extract_all({sql}, {low} || '([^' || {high} || ']+)' || {high}, 1) AS t FROM {TEXTS})"


def encode_decode_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of all documents back into text."""
    f = _functions(spark, toys.byte_bpe())
    return texts(spark, sf_dir).select("doc_id", f.decode(f.encode(F.col("text"))).alias("text"))


#: A tokenizer of words that SQL can follow: two known words, all others unknown.
WORD_IDS = {"<unk>": 0, "the": 1, "de": 2, "[CLS]": 101, "[SEP]": 102}


def _words_tokenizer() -> dict:
    return {"model": {"type": "WordLevel", "vocab": WORD_IDS, "unk_token": "<unk>"}, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": BERT}


def encode_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 16 ids, special tokens included, from either side."""
    f = _functions(spark, _words_tokenizer())
    return _digested(texts(spark, sf_dir), first=f.encode(F.col("text"), max_length=16), last=f.encode(F.col("text"), max_length=16, side="left"))


def encode_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of word-level tokens, one row a token: byte ranges of the words."""
    vocab = {"model": {"type": "WordLevel", "vocab": {"<unk>": 0, "the": 1}, "unk_token": "<unk>"}, "pre_tokenizer": {"type": "WhitespaceSplit"}}
    made = texts(spark, sf_dir).select("doc_id", _functions(spark, vocab).encode_with_offsets(F.col("text")).alias("e"))
    flat = made.select("doc_id", F.transform("e.offsets", lambda o: F.concat_ws("-", o["start"], o["end"])).alias("o"))
    return flat.select("doc_id", F.size("o").cast("bigint").alias("n"), F.md5(F.encode(F.array_join("o", ","), "UTF-8")).alias("digest"))


def encode_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its language and source as second text: ids and type ids."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.concat_ws(" ", "lang", "source").alias("other"))
    made = docs.select("doc_id", _functions(spark, _words_tokenizer()).encode_pair(F.col("text"), F.col("other")).alias("e"))
    return _digested(made, ids=F.col("e.ids"), types=F.col("e.type_ids"))


def convert_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word of the texts occurs, with its id, and the token of that id: by joins with the vocabulary."""
    f = _functions(spark, _words_tokenizer())
    words = texts(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"\P{IsWhite_Space}+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return f.with_tokens(f.with_ids(words, "word"), "id").select("word", "n", F.col("id").cast("bigint").alias("id"), "token")


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.tables import conversations

    return conversations(table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))))


def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each conversation."""
    from ..core.tokenizer import Tokenizer
    from ..functions.tables import apply_chat_template

    made = apply_chat_template(_chats(spark, sf_dir), Tokenizer(toys.byte_bpe(), {"chat_template": toys.CHAT}), add_generation_prompt=True)
    return made.select("conv_id", "prompt")


def chat_assistant_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ids of each conversation there are, and how many the assistant wrote."""
    from ..core.tokenizer import Tokenizer
    from ..functions.tables import assistant_mask

    plain = toys.byte_bpe()
    plain["model"] = plain["model"] | {"merges": []}  # a byte is an id, so that SQL can count
    made = assistant_mask(_chats(spark, sf_dir), Tokenizer(plain, {"chat_template": toys.CHAT}))
    return made.select("conv_id", F.size("ids").cast("bigint").alias("n"), F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("n_assistant"))


def response_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns read by a response template."""
    from ..functions.tables import parse_response

    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.select("conv_id", "turn", parse_response(F.col("text"), toys.RESPONSE).alias("message"))


def stream_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each conversation turn, decoded as a stream: the text again."""
    from ..core.tokenizer import Tokenizer
    from ..streaming import batch_decode

    tokenizer = Tokenizer(toys.byte_bpe())
    f = _functions(spark, toys.byte_bpe())
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), F.posexplode(f.encode(F.col("text"))).alias("seq", "token"))
    return batch_decode(turns, tokenizer).select(F.col("key").alias("stream_id"), "text")


def transcript_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.tables import basic_normalize

    return texts(spark, sf_dir).select("doc_id", basic_normalize(F.col("text"), True).alias("normalized"))


def transcript_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English normalization of all documents, as transcript_basic: it is of a text, whatever its lang says."""
    from ..functions.tables import english_normalize

    return texts(spark, sf_dir).select("doc_id", english_normalize(F.col("text")).alias("normalized"))


def norm_nfkd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", _functions(spark, _with({"type": "NFKD"})).normalize(F.col("text")).alias("normalized"))


def norm_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFC of texts that were decomposed first."""
    f = _functions(spark, _with({"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "NFC"}]}))
    return texts(spark, sf_dir).select("doc_id", f.normalize(F.col("text")).alias("normalized"))


def norm_bert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without accents, in lower case."""
    return texts(spark, sf_dir).select("doc_id", _functions(spark, _with({"type": "BertNormalizer"})).normalize(F.col("text")).alias("normalized"))


def pre_unicode_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which some letters are made Greek, cut where the script changes."""
    f = _functions(spark, _with(None, {"type": "UnicodeScripts"}))
    return texts(spark, sf_dir).select("doc_id", F.size(f.pre_tokenize(F.translate("text", "aeo", "αεο"))).cast("bigint").alias("n_pieces"))


def pre_merged_with_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts before each comma or period: what follows stays with it."""
    f = _functions(spark, _with(None, {"type": "Split", "pattern": {"Regex": "[.,]"}, "behavior": "MergedWithNext"}))
    made = texts(spark, sf_dir).select("doc_id", f.pre_tokenize(F.col("text")).alias("p"))
    return made.select("doc_id", F.size("p").cast("bigint").alias("n_pieces"), F.md5(F.encode(F.array_join("p", "\x01"), "UTF-8")).alias("digest"))


def pre_merged_with_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts after each comma or period: it stays with what comes before."""
    f = _functions(spark, _with(None, {"type": "Split", "pattern": {"Regex": "[.,]"}, "behavior": "MergedWithPrevious"}))
    made = texts(spark, sf_dir).select("doc_id", f.pre_tokenize(F.col("text")).alias("p"))
    return made.select("doc_id", F.size("p").cast("bigint").alias("n_pieces"), F.md5(F.encode(F.array_join("p", "\x01"), "UTF-8")).alias("digest"))


def _with(normalize: dict | None, pre: dict | None = None) -> dict:
    return {"normalizer": normalize, "pre_tokenizer": pre, "model": {"type": "WordLevel", "vocab": {"<unk>": 0}, "unk_token": "<unk>"}}


def added_tokens_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added tokens found in texts: how many of each document."""
    data = _with(None, {"type": "WhitespaceSplit"}) | {"added_tokens": [{"id": 7, "content": "tion", "special": True}, {"id": 8, "content": "th", "special": True}]}
    made = texts(spark, sf_dir).select("doc_id", _functions(spark, data).encode(F.col("text")).alias("ids"))
    return made.select("doc_id", F.size(F.filter("ids", lambda i: i == 7)).cast("bigint").alias("n_tion"), F.size(F.filter("ids", lambda i: i == 8)).cast("bigint").alias("n_th"))


for f in (model_bpe_tokens, encode_decode_round_trip, encode_truncated, encode_offsets, encode_pairs, convert_tokens, chat_prompts, chat_assistant_mask, response_messages, stream_decoded, transcript_basic, transcript_english, norm_nfkd, norm_nfc, norm_bert, pre_unicode_scripts, pre_merged_with_next, pre_merged_with_previous, added_tokens_split):
    QUERIES[f.__name__] = f
ORACLES["model_bpe_tokens"] = _bpe_sql()
ORACLES["encode_decode_round_trip"] = f"SELECT doc_id, text FROM {TEXTS}"
ORACLES["encode_offsets"] = f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '{NWS}+') AS w, regexp_extract_all(text, '{WS}+') AS s, CASE WHEN regexp_matches(text, '^{WS}') THEN 1 ELSE 0 END AS lead FROM {TEXTS}),
 spans AS (SELECT doc_id, i, octet_length(encode(w[i])) AS n, coalesce(octet_length(encode(s[i - 1 + lead])), 0) AS gap FROM w, unnest(range(1, len(w) + 1)) AS t(i)),
 ends AS (SELECT doc_id, i, n, sum(n + gap) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM spans),
 made AS (SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg((e - n)::BIGINT::VARCHAR || '-' || e::BIGINT::VARCHAR, ',' ORDER BY i)) AS digest FROM ends GROUP BY doc_id)
 SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n, coalesce(digest, md5('')) AS digest FROM w LEFT JOIN made USING (doc_id)"""
ORACLES["chat_prompts"] = "SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn) || '<|assistant|>' || chr(10) AS prompt FROM conversations GROUP BY conv_id"
ORACLES["stream_decoded"] = "SELECT conv_id * 1000 + turn AS stream_id, text FROM conversations WHERE text <> ''"
ORACLES["norm_nfc"] = f"SELECT doc_id, nfc_normalize(text) AS normalized FROM {TEXTS}"
ORACLES["norm_bert"] = rf"SELECT doc_id, lower(strip_accents(regexp_replace(text, '\s', ' ', 'g'))) AS normalized FROM {TEXTS}"
ORACLES["pre_merged_with_previous"] = f"SELECT doc_id, len(p)::BIGINT AS n_pieces, md5(array_to_string(p, chr(1))) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '(?s)[^.,]+[.,]?|[.,]') AS p FROM {TEXTS})"
ORACLES["pre_merged_with_next"] = f"SELECT doc_id, len(p)::BIGINT AS n_pieces, md5(array_to_string(p, chr(1))) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '(?s)[.,]?[^.,]+|[.,]') AS p FROM {TEXTS})"
ORACLES["added_tokens_split"] = f"SELECT doc_id, len(regexp_extract_all(text, 'tion'))::BIGINT AS n_tion, len(regexp_extract_all(replace(text, 'tion', '.'), 'th'))::BIGINT AS n_th FROM {TEXTS}"

from . import checked  # noqa: E402, F401  its queries and SQL join these
