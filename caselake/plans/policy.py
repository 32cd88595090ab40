"""Policy queries on conversations, documents and pages: a ruleset of words that these tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import russian as RU
from ..functions import text as T
from ..operators import cases, policy
from ..registry import query, read

RULES = {
    "ruleset_version": "tables.1",
    "normalization": {"fold_yo": True, "max_char_run": 3, "zero_width": ["​", "­"], "word_merge": {"max_words": 5, "max_word_len": 3, "require_short_word_len": 2}},
    "profanity_rules": [{"rule_id": "insult", "kind": "exact", "script": "latin", "max_masked": 1, "tokens": ["worthless", "moron", "stupid", "idiot", "pathetic"]}],
    "human_request": {
        "person_targets": ["that", "der", "les"], "channel_targets": ["the", "und"], "transfer_markers": ["of", "von", "dans"], "need_markers": ["in", "ein", "une"], "max_gap_tokens": 2,
        "phrase_rules": [{"rule_id": "phrase", "pattern": r"\bto (?:the|and)\b"}], "politeness_tokens": ["and", "is", "den", "est"],
        "suppressors": [{"rule_id": policy.HOWTO, "question_pattern": r"\b(?:whou|was|que)\b", "contact_pattern": r"\b(?:for|auf|pas)"}, {"rule_id": policy.NEGATION, "pattern": r"\b(?:on|im|de)\b"}],
    },
}
GAPPED = r"[trim(regexp_replace(y, '[^\p{L}\p{N}]', '*', 'g'), '*') FOR y IN regexp_split_to_array(folded, '\s+')]"
#: Readings of Latin words and joined rows of short ones, as lists.
CANDIDATES = (
    "t AS (SELECT {keys}, {folded} AS folded FROM {table}),"
    " w AS (SELECT {keys}, [x FOR x IN " + GAPPED + " IF x <> ''] AS w FROM t),"
    " l AS (SELECT *, [length(replace(x, '*', '')) FOR x IN w] AS l FROM w),"
    " c AS (SELECT {keys}, w, flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(list_filter(range(1, 5), lambda j: i + j <= len(w) AND list_max(l[i:i + j]) <= 3 AND list_min(l[i:i + j]) <= 2), lambda j: array_to_string(w[i:i + j], '')))) AS joined FROM l)"
)


def folded_sql(column: str = "coalesce(text, '')") -> str:
    """T.fold for the signs that the tables hold; their texts are in NFKC already."""
    out = f"replace(replace(lower({column}), 'ß', 'ss'), 'ё', 'е')"
    for sign in [chr(c) for c in range(32, 127) if not chr(c).isupper()] + list("àâäçèéêëîïíñóôöùúûü¿¡«»…—’"):
        said = "''" if sign == "'" else f"\\{sign}" if sign in r"\.[]{}()*+?^$|" else sign
        out = f"regexp_replace({out}, '{said}{{4,}}', '{said * 3 if said != chr(92) + sign else (sign * 3).replace(chr(92), chr(92) * 2)}', 'g')"
    return out


EXACT = RULES["profanity_rules"][0]["tokens"]
MASKED = "|".join(rf"{t[:i]}\*{t[i + 1:]}" for t in EXACT for i in range(len(t)))
PROFANE = f"len([x FOR x IN list_concat(w, joined) IF replace(x, '*', '') IN {tuple(EXACT)} OR regexp_full_match(x, '{MASKED}')]) > 0"


def candidates_sql(keys: str, table: str) -> str:
    return CANDIDATES.replace("{keys}", keys).replace("{table}", table).replace("{folded}", folded_sql())


SENTENCES = r"""s AS (SELECT conv_id, turn, trim(regexp_replace(unnest(regexp_split_to_array(""" + folded_sql() + r""", '[.!?;\n]+')), '[^\p{L}\p{N}_]+', ' ', 'g')) AS s FROM conversations),
x AS (SELECT conv_id, turn, ' ' || s || ' ' AS s, string_split(s, ' ') AS w FROM s WHERE s <> ''),
f AS (SELECT *, regexp_matches(s, ' (whou|was|que) ') AND regexp_matches(s, ' (for|auf|pas)') AS howto, regexp_matches(s, ' (on|im|de) ') AS negation, regexp_matches(s, ' to (the|and) ') AS phrase,
  [CASE WHEN regexp_matches(v, '^(that|der|les)') THEN 'person' WHEN regexp_matches(v, '^(the|und)') THEN 'channel' END FOR v IN w] AS k FROM x),
g AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: w[i] IN ('of', 'von', 'dans') AND len([v FOR v IN k[greatest(i - 2, 1):i + 2] IF v IS NOT NULL]) > 0) AS transfer,
  list_filter(range(1, len(w) + 1), lambda i: w[i] IN ('in', 'ein', 'une') AND len([v FOR v IN k[greatest(i - 2, 1):i + 2] IF v = 'person']) > 0) AS need,
  len([i FOR i IN range(1, len(w) + 1) IF k[i] = 'person']) AS persons, len([i FOR i IN range(1, len(w) + 1) IF coalesce(k[i], '') <> 'person' AND w[i] NOT IN ('and', 'is', 'den', 'est')]) AS others FROM f),
h AS (SELECT conv_id, turn, bool_or(NOT howto AND len(transfer) > 0) AS t, bool_or(NOT howto AND NOT negation AND len(need) > 0) AS n, bool_or(NOT howto AND phrase) AS p, bool_or(NOT howto AND NOT negation AND persons > 0 AND others = 0) AS o FROM g GROUP BY ALL)"""
TOLD = f"concat_ws(',', CASE WHEN n THEN '{policy.NEED}' END, CASE WHEN o THEN '{policy.TARGET_ONLY}' END, CASE WHEN t THEN '{policy.TRANSFER}' END, CASE WHEN p THEN 'phrase' END)"


def technical(spark, d):
    """Page addresses in several forms, which hold most kinds of technical spans."""
    url = F.col("url")
    return read(spark, d, "pages").select("page_id", F.concat_ws(" ", url, F.substring(url, 8, 500), F.concat(F.lit("0x"), F.md5(url)), F.concat(F.lit("page_id"), F.col("page_id").cast("string")), F.concat(F.lit("_r"), F.col("page_id").cast("string")), F.lit("someName"), F.concat(F.lit("q+r@"), F.substring(url, 8, 500)), F.concat(F.lit('File "'), url, F.lit('", line '), F.col("page_id").cast("string"))).alias("text"))


def technical_sql() -> str:
    out, hits = "", []
    steps = ["x0 AS (SELECT page_id, concat_ws(' ', url, substr(url, 8, 500), '0x' || md5(url), 'page_id' || page_id, '_r' || page_id, 'someName', 'q+r@' || substr(url, 8, 500), 'File \"' || url || '\", line ' || page_id) AS x FROM pages)"]
    for no, (name, pattern) in enumerate(T.TECHNICAL.items()):
        said = pattern.replace("(?U)", "").replace("'", "''")
        hits.append(f"CASE WHEN h{no} THEN '{name}' END")
        had = "".join(f", h{i}" for i in range(no))
        steps.append(f"x{no + 1} AS (SELECT page_id{had}, regexp_matches(x, '{said}') AS h{no}, regexp_replace(x, '{said}', ' ', 'g') AS x FROM x{no})")
    return f"WITH {', '.join(steps)} SELECT page_id, x AS clean, concat_ws(',', {', '.join(hits)}) AS hits FROM x{len(T.TECHNICAL)}{out}"


@query("f14_masked_spans", technical_sql())
def f14(spark, d):
    clean, hits = T.mask_technical("text")
    return technical(spark, d).select("page_id", clean.alias("clean"), F.array_join(hits, ",").alias("hits"))


@query("f15_fold", f"SELECT conv_id, turn, {folded_sql()} AS folded FROM conversations")
def f15(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.fold(RU.nfkc("text")).alias("folded"))


@query("f16_candidates", f"WITH {candidates_sql('conv_id, turn', 'conversations')} SELECT conv_id, turn, CAST(len(w) + len(joined) AS BIGINT) AS n, CAST(list_sum([length(x) FOR x IN list_concat(w, joined)]) AS BIGINT) AS signs FROM c WHERE len(w) > 0")
def f16(spark, d):
    rows = policy.match_candidates(read(spark, d, "conversations"), RULES, ["conv_id", "turn"])
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum(F.length("reading")).alias("signs"))


@query("f17_profanity", f"WITH {candidates_sql('doc_id', 'documents')} SELECT doc_id, {PROFANE} AS profane FROM c")
def f17(spark, d):
    return policy.policy_labels(read(spark, d, "documents"), RULES | {"human_request": {}}, ["doc_id"]).select("doc_id", (F.size("profanity") > 0).alias("profane"))


@query("f18_human_request", f"WITH {SENTENCES} SELECT conv_id, turn, coalesce({TOLD}, '') AS rules FROM conversations LEFT JOIN h USING (conv_id, turn)")
def f18(spark, d):
    rows = policy.policy_labels(read(spark, d, "conversations"), RULES | {"profanity_rules": []}, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.array_join(F.array_sort("human"), ",").alias("rules"))


D6_SQL = f"WITH {candidates_sql('conv_id, turn', 'conversations')}, {SENTENCES}, y AS (SELECT conv_id, turn, {PROFANE} AS profane, coalesce({TOLD}, '') AS told FROM c LEFT JOIN h USING (conv_id, turn)) SELECT conv_id, turn, CASE WHEN profane THEN 'insult' ELSE '' END AS profanity, told <> '' AND NOT profane AS human_request, CASE WHEN profane THEN 'policy_closed' WHEN told <> '' THEN 'handoff' ELSE 'pass' END AS verdict FROM y"


@query("d6_policy_labels", D6_SQL)
def d6(spark, d):
    return policy.policy_labels(read(spark, d, "conversations"), RULES, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join("profanity", ",").alias("profanity"), "human_request", "verdict")


@query("d9_chat_mode", "SELECT conv_id, turn, CASE WHEN regexp_matches(coalesce(text,''), 'stupid') THEN 'policy' WHEN turn % 4 = 3 THEN 'handoff' WHEN role = 'system' THEN 'operator' ELSE 'ai' END AS mode FROM conversations")
def d9(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", cases.chat_mode(F.coalesce("text", F.lit("")).contains("stupid"), F.col("turn") % 4 == 3, F.col("role") == "system").alias("mode"))


#: A ruleset with stems in Cyrillic, and texts with the rules that they break, as a table for both sides.
STEMS = {
    "ruleset_version": "stems.1",
    "normalization": {"fold_yo": True, "max_char_run": 3, "zero_width": ["\u200b", "\u00ad"], "homoglyph_map": {"a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "y": "у", "k": "к", "b": "в", "x": "х"}, "digit_map": {"0": "о", "3": "з", "4": "ч", "6": "б"}, "word_merge": {"max_words": 5, "max_word_len": 3, "require_short_word_len": 2}},
    "technical_spans": [{"id": "URL", "pattern": "https?://\\S+"}],
    "profanity_rules": [
        {"rule_id": "stem", "kind": "stem", "atoms": ["д", "у", "р", "ао", "к"], "prefixes": ["", "по", "не"], "max_suffix": 3, "max_masked": 1, "exception_token_prefixes": ["дуракав"]},
        {"rule_id": "exact", "kind": "exact", "script": "cyrillic", "max_masked": 1, "tokens": ["болван", "чурбан"]},
    ],
    "human_request": {},
}
SAID = {
    "ты дурак": "stem", "ДУРАК!": "stem", "д.у р а к": "stem", "дypaк": "stem", "ду*ак": "stem", "д**ак": "", "дууурак": "stem", "подураки": "stem", "дуракаваляние": "", "мудурак": "", "дур0к": "stem", "duрак": "", "ду\u200bрак": "stem", "https://дурак.ru": "",
    "болван": "exact", "бо-л-ван": "exact", "б*лван": "exact", "б*лв*н": "", "болвана": "", "дурак и болван": "exact,stem", "добрый день": "",
}


def said(spark, d):
    """Each message with one of the texts in place of its own."""
    text = F.get(F.array(*[F.lit(x) for x in SAID]), ((F.col("conv_id") * 5 + F.col("turn")) % len(SAID)).cast("int"))
    return read(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))


@query("f17_stems", "SELECT conv_id, turn, rules FROM conversations JOIN (VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(SAID.values())) + f") v(i, rules) ON i = (conv_id * 5 + turn) % {len(SAID)}")
def f17_stems(spark, d):
    """Stems, masks, gaps, look-alike letters and digits, joined words, exceptions and links."""
    return policy.policy_labels(said(spark, d), STEMS, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join(F.array_sort("profanity"), ",").alias("rules"))


#: Readings of words that mix letters, digits and signs; of short words also joined.
READ = {"п3р": "п*р,пзр", "о д": "д,о,од", "he.llo": "he*llo", "дypaк": "дурак", "": ""}


@query("f16_readings", "SELECT conv_id, turn, readings FROM conversations JOIN (VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(READ.values())) + f") v(i, readings) ON i = (conv_id + turn) % {len(READ)} WHERE readings <> ''")
def f16_readings(spark, d):
    text = F.get(F.array(*[F.lit(x) for x in READ]), ((F.col("conv_id") + F.col("turn")) % len(READ)).cast("int"))
    rows = policy.match_candidates(read(spark, d, "conversations").select("conv_id", "turn", text.alias("text")), STEMS, ["conv_id", "turn"])
    return rows.groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.collect_set("reading")), ",").alias("readings"))
