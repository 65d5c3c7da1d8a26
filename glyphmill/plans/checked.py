"""SQL of the models, of pairs and truncation, and of more patterns: what the queries of queries.py leave to the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import toys
from .queries import ALPHABET, NWS, ORACLES, QUERIES, TEXTS, WORD, WORDS, _bpe_sql, _digest, _digested, _functions, _pieced, _repeat, _with, _words_tokenizer, texts


def _values(rows: list[tuple]) -> str:
    def one(v: object) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def _digest_sql(ids: str) -> str:
    return f"len({ids})::BIGINT AS n, md5(array_to_string({ids}, ',')) AS digest"


def _word_id(words: str) -> str:
    return f"list_transform({words}, lambda x: CASE x WHEN 'the' THEN 1 WHEN 'de' THEN 2 ELSE 0 END)"


WORD_IDS_SQL = f"(SELECT doc_id, {_word_id('w')} AS ids FROM {WORDS})"
_A = _word_id(f"regexp_extract_all(coalesce(text, ''), '{NWS}+')")
_B = _word_id(f"regexp_extract_all(concat_ws(' ', lang, source), '{NWS}+')")
ORACLES["encode_truncated"] = f"SELECT doc_id, md5(array_to_string([101] || ids[1:14] || [102], ',')) AS first, md5(array_to_string([101] || list_slice(ids, greatest(len(ids) - 13, 1), len(ids)) || [102], ',')) AS last FROM {WORD_IDS_SQL}"
ORACLES["encode_pairs"] = f"""WITH pairs AS (SELECT doc_id, {_A} AS a, {_B} AS b FROM documents)
 SELECT doc_id, md5(array_to_string([101] || a || [102] || b || [102], ',')) AS ids, md5(array_to_string({_repeat(0, 'len(a) + 2')} || {_repeat(1, 'len(b) + 1')}, ',')) AS types FROM pairs"""
ORACLES["convert_tokens"] = f"SELECT word, count(*) AS n, CASE word WHEN 'the' THEN 1 WHEN 'de' THEN 2 WHEN '[CLS]' THEN 101 WHEN '[SEP]' THEN 102 ELSE 0 END::BIGINT AS id, CASE WHEN word IN ('the', 'de', '[CLS]', '[SEP]') THEN word ELSE '<unk>' END AS token FROM (SELECT unnest(w) AS word FROM {WORDS}) GROUP BY word"
ORACLES["chat_assistant_mask"] = "SELECT conv_id, sum(octet_length(encode('<|' || role || '|>' || chr(10) || coalesce(text, ''))) + 2)::BIGINT AS n, sum(CASE WHEN role = 'assistant' THEN octet_length(encode(coalesce(text, ''))) ELSE 0 END)::BIGINT AS n_assistant FROM conversations GROUP BY conv_id"
ORACLES["pre_unicode_scripts"] = rf"SELECT doc_id, greatest(len(regexp_extract_all(replace(translate(text, 'aeo', 'αεο'), ' ', ''), '\p{{Greek}}+|\p{{Latin}}+|[^\p{{Greek}}\p{{Latin}}]+')), CASE WHEN text <> '' THEN 1 ELSE 0 END)::BIGINT AS n_pieces FROM {TEXTS}"

#: Decompositions of the letters of the texts: marks, the plain letters and the whole ones.
DECOMPOSED = ((0x301, "aeiouyAEIOUY", "áéíóúýÁÉÍÓÚÝ"), (0x300, "aeiouAEIOU", "àèìòùÀÈÌÒÙ"), (0x302, "aeiouAEIOU", "âêîôûÂÊÎÔÛ"), (0x308, "aeiouyAEIOU", "äëïöüÿÄËÏÖÜ"), (0x303, "anoANO", "ãñõÃÑÕ"), (0x327, "cC", "çÇ"))


def _nfkd_sql(text: str) -> str:
    for mark, plain, whole in DECOMPOSED:  # the mark behind the letter, then the letter without it
        text = rf"translate(regexp_replace({text}, '([{whole}])', '\1' || chr({mark}), 'g'), '{whole}', '{plain}')"
    return text


ORACLES["norm_nfkd"] = f"SELECT doc_id, {_nfkd_sql('text')} AS normalized FROM {TEXTS}"
_BARE = r"regexp_replace(regexp_replace(lower(text), '[<\[][^>\]]*[>\]]', '', 'g'), '\([^)]+?\)', '', 'g')"
_BARE = f"replace(replace(replace({_BARE}, 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"
ORACLES["transcript_basic"] = rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_nfkd_sql(_BARE)}, '\p{{Mn}}', '', 'g'), '[\p{{M}}\p{{S}}\p{{P}}]', ' ', 'g'), '\s+', ' ', 'g') AS normalized FROM {TEXTS}"


def _word_piece_sql() -> str:
    """The longest piece that fits, again and again, of each distinct word."""
    data = toys.word_piece()
    rows = [(t[2:] if t.startswith("##") else t, t.startswith("##"), i) for t, i in data["model"]["vocab"].items() if t not in ("[UNK]", "[CLS]", "[SEP]", "##")]
    unk, cls, sep = (data["model"]["vocab"][t] for t in ("[UNK]", "[CLS]", "[SEP]"))
    lowered = ORACLES["norm_bert_uncased_keep_accents"]
    return rf"""WITH RECURSIVE vocab(piece, inner_, id) AS {_values(rows)},
 pieces AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS w FROM (SELECT doc_id, regexp_extract_all(normalized, '[\p{{P}}$+<=>^`|~]|[^\p{{P}}$+<=>^`|~\s]+') AS p FROM ({lowered}))),
 steps AS (
  SELECT w, 1::BIGINT AS place, []::INT[] AS ids FROM (SELECT DISTINCT w FROM pieces) WHERE length(w) <= 100
  UNION ALL
  SELECT w, place + max(length(piece)), any_value(ids) || [arg_max(id, length(piece))] FROM steps JOIN vocab ON starts_with(substr(w, place), piece) AND inner_ = (place > 1) WHERE place <= length(w) GROUP BY w, place),
 words AS (SELECT w, ids FROM steps WHERE place > length(w)),
 found AS (SELECT doc_id, flatten(list(coalesce(ids, [{unk}]) ORDER BY pos)) AS ids FROM pieces LEFT JOIN words USING (w) GROUP BY doc_id),
 framed AS (SELECT doc_id, [{cls}] || coalesce(ids, []) || [{sep}] AS ids FROM {TEXTS} LEFT JOIN found USING (doc_id))
 SELECT doc_id, {_digest_sql('ids')} FROM framed"""


def _id_map(vocab: dict[str, int]) -> str:
    return "MAP {" + ", ".join("'" + t.replace("'", "''") + f"': {i}" for t, i in vocab.items()) + "}"


def _bpe_ids_sql() -> str:
    vocab = toys.bpe()["model"]["vocab"]
    tokens = _bpe_sql().split(" FROM ", 1)[1]
    return f"WITH ids AS (SELECT doc_id, list_transform(t, lambda x: m[x]) AS ids FROM {tokens}, (SELECT {_id_map(vocab)} AS m)) SELECT doc_id, {_digest_sql('ids')} FROM ids"


def _byte_bpe_sql() -> str:
    """As for scalars, over the byte alphabet of the pieces of the gpt2 pattern."""
    data, low, high = toys.byte_bpe(), "chr(2)", "chr(3)"
    pieces = ORACLES["pre_gpt2_pattern"]
    cut = pieces[pieces.index("list_filter(list_filter(") + len("list_filter(") : pieces.index(", lambda x: x <> '') AS p")]
    letters = f"array_to_string(list_transform({cut}, lambda p: chr(4) || array_to_string(list_transform(regexp_extract_all(hex(encode(p)), '..'), lambda h: {low} || list_extract(a, ('0x' || h)::INT + 1) || {high}), '')), '')"
    sql = "made"
    for x, y in data["model"]["merges"]:
        sql = f"replace({sql}, {low} || '{x}' || {high} || {low} || '{y}' || {high}, {low} || '{x}{y}' || {high})"
    return f"""{ALPHABET}, made AS (SELECT doc_id, {letters} AS made FROM {TEXTS}, alphabet), tokens AS (SELECT doc_id, regexp_extract_all({sql}, {low} || '([^' || {high} || ']+)' || {high}, 1) AS t FROM made),
 ids AS (SELECT doc_id, list_transform(t, lambda x: m[x]) AS ids FROM tokens, (SELECT {_id_map(data['model']['vocab'])} AS m)) SELECT doc_id, {_digest_sql('ids')} FROM ids"""


ORACLES["model_word_piece_encode"] = _word_piece_sql()
ORACLES["model_bpe_encode"] = _bpe_ids_sql()
ORACLES["model_byte_bpe_encode"] = _byte_bpe_sql()


def model_bpe_by_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the scalar BPE, each distinct piece of all documents encoded once."""
    made = _functions(spark, toys.bpe()).encode_by_pieces(texts(spark, sf_dir), "doc_id", "text")
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n"), _digest(F.col("ids")).alias("digest"))


QUERIES["model_bpe_by_pieces"] = model_bpe_by_pieces
ORACLES["model_bpe_by_pieces"] = ORACLES["model_bpe_encode"]


#: Published patterns of other tokenizers.
LLAMA3 = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
QWEN2 = LLAMA3.replace("{1,3}", "")


def _modern_sql(digits: str) -> str:
    """As for gpt2: a mark where a run of white space gives its last one, unless that ends a line, to what follows."""
    pattern = rf"(?i:''s|''t|''re|''ve|''m|''ll|''d)|[^\r\n\p{{L}}\p{{N}}' || chr(1) || ']?\p{{L}}+|{digits}| ?[^\s\p{{L}}\p{{N}}' || chr(1) || ']+[\r\n]*|\s*[\r\n]+|\s+"
    return rf"list_filter(regexp_extract_all(regexp_replace(text, '(\s+)([^\S\r\n]\S)', '\1' || chr(1) || '\2', 'g'), chr(1) || '|{pattern}'), lambda x: x <> chr(1))"


_pieced("pre_llama3_pattern", {"type": "Split", "pattern": {"Regex": LLAMA3}, "behavior": "Isolated"}, _modern_sql(r"\p{N}{1,3}"))
_pieced("pre_qwen2_pattern", {"type": "Split", "pattern": {"Regex": QWEN2}, "behavior": "Isolated"}, _modern_sql(r"\p{N}"))


def added_tokens_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added tokens that stand alone, take white space beside them, or are found in normalized text: how many of each."""
    data = _with({"type": "Lowercase"}, {"type": "WhitespaceSplit"}) | {"added_tokens": [{"id": 7, "content": "de", "single_word": True}, {"id": 8, "content": ".", "lstrip": True, "rstrip": True}, {"id": 9, "content": "THE", "normalized": True}]}
    made = texts(spark, sf_dir).select("doc_id", _functions(spark, data).encode(F.col("text")).alias("ids"))

    def count(token: int) -> Column:
        return F.size(F.filter("ids", lambda i: i == token)).cast("bigint")

    return made.select("doc_id", count(7).alias("n_de"), count(8).alias("n_stop"), count(9).alias("n_the"))


def added_tokens_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An added token that no text has changes nothing."""
    data = _words_tokenizer() | {"added_tokens": [{"id": 500, "content": "<|never|>", "special": True}]}
    return _digested(texts(spark, sf_dir), ids=_functions(spark, data).encode(F.col("text")))


for f in (added_tokens_flags, added_tokens_none):
    QUERIES[f.__name__] = f
ORACLES["added_tokens_none"] = f"SELECT doc_id, md5(array_to_string([101] || ids || [102], ',')) AS ids FROM {WORD_IDS_SQL}"
#: Each character that is none of a word is doubled, so that two neighbours have one each.
ORACLES["added_tokens_flags"] = rf"""SELECT doc_id, len(regexp_extract_all('.' || regexp_replace(text, '([^{WORD}])', '\1\1', 'g') || '.', '[^{WORD}]de[^{WORD}]'))::BIGINT AS n_de,
 len(regexp_extract_all(text, '\.'))::BIGINT AS n_stop, len(regexp_extract_all(lower(text), 'the'))::BIGINT AS n_the FROM {TEXTS}"""


def _unigram_sql() -> str:
    """The best path to each place of each distinct piece, place by place: score and ids of what ends there."""
    rows = toys.unigram()["model"]["vocab"]
    known = [(t, i, s) for i, (t, s) in enumerate(rows) if i]
    longest, unk = max(len(t) for t, _, _ in known), min(s for _, s in rows) - 10.0
    zero = next(i for t, i, _ in known if t == "<0x00>")
    ids = "MAP {" + ", ".join("'" + t.replace("'", "''") + f"': {i}" for t, i, _ in known) + "}"
    scores = "MAP {" + ", ".join("'" + t.replace("'", "''") + f"': {s!r}::DOUBLE" for t, _, s in known) + "}"
    spelled = f"list_transform(regexp_extract_all(hex(encode(substr(w, place, 1))), '..'), lambda h: {zero} + ('0x' || h)::INT)"
    piece = "substr(w, place, e - place)"
    offered = f"CASE WHEN e > place AND e <= place + {longest} THEN score[place] + coalesce(s[{piece}], CASE WHEN e = place + 1 THEN {unk!r}::DOUBLE END) END"
    better = f"coalesce({offered} > score[e], {offered} IS NOT NULL)"
    return f"""WITH RECURSIVE known AS (SELECT {ids} AS i, {scores} AS s),
 marked AS (SELECT doc_id, replace(lower(nfc_normalize(text)), ' ', '▁') AS t FROM {TEXTS}),
 pieces AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS w FROM (SELECT doc_id, regexp_extract_all(CASE WHEN t = '' OR starts_with(t, '▁') THEN t ELSE '▁' || t END, '▁?[^▁]+|▁') AS p FROM marked)),
 steps AS (
  SELECT w, 1::BIGINT AS place, [0::DOUBLE] || list_transform(range(0, length(w)), lambda e: NULL::DOUBLE) AS score, list_transform(range(0, length(w) + 1), lambda e: []::INT[]) AS ids FROM (SELECT DISTINCT w FROM pieces)
  UNION ALL
  SELECT w, place + 1, list_transform(range(1, length(w) + 2), lambda e: CASE WHEN {better} THEN {offered} ELSE score[e] END),
         list_transform(range(1, length(w) + 2), lambda e: CASE WHEN {better} THEN ids[place] || CASE WHEN s[{piece}] IS NULL THEN {spelled} ELSE [i[{piece}]] END ELSE ids[e] END)
  FROM steps, known WHERE place <= length(w)),
 words AS (SELECT w, ids[length(w) + 1] AS ids FROM steps WHERE place > length(w)),
 found AS (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM pieces JOIN words USING (w) GROUP BY doc_id),
 whole AS (SELECT doc_id, coalesce(ids, []) AS ids FROM {TEXTS} LEFT JOIN found USING (doc_id))
 SELECT doc_id, {_digest_sql('ids')} FROM whole"""


ORACLES["model_unigram_encode"] = _unigram_sql()
