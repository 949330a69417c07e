"""Queries of the text, record and small column operators over all of part (its names, types, brands and sizes put together to
rules texts), each with SQL that says the same in its own words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import exprs, normalize as norm, segment
from ..operators import filters, fragments as frag, records
from ..operators.encode import HashingEncoder, mean_pool
from .catalog import T, lines, query, spread, table

KEYWORDS = ("flying", "vigilance", "haste", "ward", "protection", "cycling", "bushido", "overload")
TEMPLATES = {"Cycling {cost}": "{cost}, Discard this card: Draw a card.", "Ward {cost}": "Counter it unless they pay {cost}.", "Flying": "It stays above."}

# parts of texts in the SQL that both engines read
TYPE_LINE = """CASE p_partkey % 10 WHEN 0 THEN 'Creature — Elf' WHEN 1 THEN 'Legendary Artifact Creature — Golem' WHEN 2 THEN 'Land' WHEN 3 THEN 'Basic Land — Forest'
WHEN 4 THEN 'Artifact' WHEN 5 THEN 'Enchantment — Land' WHEN 6 THEN 'Instant' WHEN 7 THEN 'Sorcery // Land' WHEN 8 THEN 'Legendary Planeswalker — X' END"""
SIGN = "CASE p_partkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '' END"
WORDS = "[" + ", ".join(f"'{w}'" for w in exprs.NUMBER_WORDS) + "]"
TIDY = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def word(n: str) -> str:
    """DuckDB's name of a number."""
    return f"CASE WHEN ({n}) <= 25 THEN {WORDS}[(({n}) + 1)::BIGINT] ELSE ({n})::VARCHAR END"


def parts(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """part with columns given as SQL."""
    rows = spread(table(spark, sf_dir, "part"), "p_partkey")
    return rows.select("*", *(F.expr(sql).alias(name) for name, sql in columns.items()))


def said(spark: SparkSession, sf_dir: str, change, **columns: str) -> DataFrame:  # noqa: ANN001
    """(p_partkey, said) of a column builder over parts."""
    return parts(spark, sf_dir, **columns).select("p_partkey", change(*(F.col(c) for c in columns)).alias("said"))


# normalization


@query(
    f"""WITH w AS (SELECT p_partkey, string_split(lower(replace(string_split(coalesce({TYPE_LINE}, ''), '—')[1], '//', ' ')), ' ') AS w FROM part)
SELECT p_partkey, CASE WHEN list_contains(w, 'creature') THEN 'this creature' WHEN list_contains(w, 'planeswalker') THEN 'this planeswalker' WHEN list_contains(w, 'land') THEN 'this land'
WHEN list_contains(w, 'artifact') THEN 'this artifact' WHEN list_contains(w, 'enchantment') THEN 'this enchantment' WHEN list_contains(w, 'instant') OR list_contains(w, 'sorcery') THEN 'this spell' ELSE 'this card' END AS said FROM w"""
)
def text_self_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, norm.self_reference, t=TYPE_LINE)


REMINDED = "concat(p_name, ' (', p_type, ') ends (', p_brand, ')')"


@query(
    rf"""SELECT p_partkey, CASE WHEN lower({TYPE_LINE}) LIKE '%land%' AND regexp_matches(lower({TYPE_LINE}), 'plains|island|swamp|mountain|forest')
THEN regexp_replace({REMINDED}, '\(([^)]*)\)', ' \1 ', 'g') ELSE regexp_replace({REMINDED}, '\([^)]*\)', ' ', 'g') END AS said FROM part"""
)
def text_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, norm.reminders, x=REMINDED, t=TYPE_LINE)


NAME = "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE concat(p_name, ', of ', p_type) END"
NAMED = f"concat({NAME}, ' fights. ', p_name, ' wins, not ', p_name, 's; ', p_name)"
_EDGE = r"[\s.,;:!?()\[\]\-]"


@query(
    rf"""WITH x AS (SELECT p_partkey, {NAME} AS n, p_name, regexp_replace({NAMED}, '(^|{_EDGE})' || {NAME} || '($|{_EDGE})', '\1this card\2', 'g') AS t FROM part)
SELECT p_partkey, CASE WHEN n <> p_name THEN regexp_replace(t, '(^|{_EDGE})' || p_name || '($|{_EDGE})', '\1this card\2', 'g') ELSE t END AS said FROM x"""
)
def text_own_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, lambda x, n: norm.own_name(x, n, F.lit("this card")), x=NAMED, n=NAME)


LINED = "concat(p_name, chr(10), '  ', p_type, CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE '' END, chr(10), chr(10), p_brand, '. ')"


@query(
    f"""SELECT p_partkey, array_to_string(list_transform(list_filter(list_transform(string_split({LINED}, chr(10)), lambda x: trim(x)), lambda x: x <> ''),
lambda x: CASE WHEN right(x, 1) IN ('.', '!', '?') THEN x ELSE x || '.' END), ' ') AS said FROM part"""
)
def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, norm.sentences, x=LINED)


SYMBOLS = "concat('Add ', repeat('{G}', CAST(p_size % 4 AS INT)), '{', p_size, '}', CASE p_partkey % 6 WHEN 0 THEN '{T}' WHEN 1 THEN '{W/U}' WHEN 2 THEN '{E}{E}' WHEN 3 THEN '{X}' WHEN 4 THEN '{C}{C}' ELSE '{Q}{Q}{Q}' END, ': go')"


@query(
    f"""WITH s AS (SELECT p_partkey, [CASE WHEN p_size % 4 > 0 THEN {word("p_size % 4")} || ' green mana' END, {word("p_size")} || ' generic mana',
CASE p_partkey % 6 WHEN 0 THEN 'tap this card' WHEN 1 THEN 'white or blue mana' WHEN 2 THEN 'two energy counters' WHEN 3 THEN 'x mana' WHEN 4 THEN 'two colorless mana' ELSE 'untap this card three times' END] AS w FROM part)
SELECT p_partkey, 'Add ' || array_to_string(list_filter(w, lambda x: x IS NOT NULL), ' and ') || ' : go' AS said FROM s"""
)
def text_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, lambda x: exprs.collapse_spaces(exprs.scan_map(x, norm.SYMBOL_RUN, lambda run: norm.symbol_words(run, F.lit("this card")))), x=SYMBOLS)


STRENGTH = f"concat('gets ', {SIGN}, p_size % 4, '/', {SIGN}, p_size % 3, ' now')"
_SAID_SIGN = "CASE p_partkey % 3 WHEN 0 THEN 'plus ' WHEN 1 THEN 'minus ' ELSE '' END"


@query(
    f"""WITH s AS (SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 4 > 0 THEN {_SAID_SIGN} || {word("p_size % 4")} || ' strength' END,
CASE WHEN p_size % 3 > 0 THEN {_SAID_SIGN} || {word("p_size % 3")} || ' toughness' END], lambda x: x IS NOT NULL), ' and ') AS w FROM part)
SELECT p_partkey, CASE WHEN w = '' THEN 'gets now' ELSE 'gets ' || w || ' now' END AS said FROM s"""
)
def text_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, lambda x: exprs.collapse_spaces(exprs.scan_map(x, norm.STRENGTHS, norm.strength_words)), x=STRENGTH)


LOYALTY = "concat(CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END, p_size, CASE WHEN p_partkey % 3 = 0 THEN ':' ELSE '' END, ' draw')"


@query(
    f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'add ' ELSE 'remove ' END || {word("p_size")} || CASE WHEN p_size = 1 THEN ' loyalty counter' ELSE ' loyalty counters' END
|| CASE WHEN p_partkey % 3 = 0 THEN ' : draw' ELSE 'draw' END AS said FROM part"""
)
def text_loyalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space behind the number belongs to the match, so it goes where no colon follows."""
    return said(spark, sf_dir, lambda x: exprs.scan_map(x, norm.LOYALTY, norm.loyalty_words), x=LOYALTY)


COSTS = "concat(CASE p_partkey % 4 WHEN 0 THEN 'two green mana, tap ' WHEN 1 THEN 'pay one mana and ' WHEN 2 THEN 'tap ' ELSE 'Mana of ' END, p_name, CASE p_partkey % 3 WHEN 0 THEN ': ' WHEN 1 THEN ' : ' ELSE ' ' END, 'draw. Each ', p_type, ' wins')"


@query(
    rf"""WITH s AS (SELECT p_partkey, regexp_split_to_array({COSTS}, '\.\s+') AS w FROM part),
c AS (SELECT p_partkey, list_transform(w, lambda x: CASE WHEN instr(x, ':') = 0 THEN x ELSE
  CASE WHEN contains(lower(string_split(x, ':')[1]), 'mana') AND NOT starts_with(lower(x), 'pay ') THEN 'pay ' ELSE '' END
  || replace(rtrim(string_split(x, ':')[1]), ',', ' and ') || CASE WHEN contains(x, ' :') THEN ' :' ELSE ':' END || string_split(x, ':')[2] END) AS w FROM s)
SELECT p_partkey, array_to_string(w, '. ') AS said FROM c"""
)
def text_pay_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, norm.pay_costs, x=COSTS)


NUMBERS = "concat('deals ', p_size, ' damage and ', p_partkey % 30, ' life')"


@query(f"SELECT p_partkey, 'deals ' || {word('p_size')} || ' damage and ' || {word('p_partkey % 30')} || ' life' AS said FROM part")
def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, lambda x: exprs.scan_map(x, r"\d+", exprs.number_word), x=NUMBERS)


MARKED = "concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' ,, ' WHEN 1 THEN ' : : ' ELSE ' / ' END, p_type, ' .. ', CASE WHEN p_partkey % 2 = 0 THEN '--+' ELSE '' END, ' end .')"


def _single(text: str) -> str:
    for mark in (r"\.", ",", "/", r"\+", "-", ":"):
        text = f"regexp_replace({text}, '{mark}{{2,}}', '{mark[-1]}', 'g')"
    return text


@query("SELECT p_partkey, " + TIDY.format(_single(rf"regexp_replace({MARKED}, '\s+([.,/+\-:])', '\1', 'g')")) + " AS said FROM part")
def text_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, norm.punctuation, x=MARKED)


VANISHING = "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('(', p_name, ')') WHEN 3 THEN '— !' ELSE p_name END"


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN p_name || '.' ELSE 'emptyoracle' END AS said FROM part")
def text_empty_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, lambda x: norm.normalize(x, F.lit(""), F.lit("")), x=VANISHING)


# segmentation


_KNOWN = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"
ONE_PART = "CASE p_partkey % 9 WHEN 0 THEN 'Flying' WHEN 1 THEN concat('ward {', p_size, '}') WHEN 2 THEN concat('Protection from ', p_name) WHEN 3 THEN 'bushido 3.' WHEN 4 THEN p_name WHEN 5 THEN 'Haste — now' WHEN 6 THEN '' WHEN 7 THEN 'cycling {1}{U}' ELSE 'flying away' END"


def is_known(part: str) -> str:
    """DuckDB's keyword test."""
    low = rf"lower(regexp_replace(trim({part}), '\.+$', ''))"
    return rf"(({low}) <> '' AND len(list_intersect([{low}, trim(regexp_replace({low}, '\s*(\{{[^}}]*\}}|[—-]\s*.*|\d+)+$', '')), string_split({low}, ' from ')[1]], {_KNOWN})) > 0)"


@query(f"SELECT p_partkey, {is_known(ONE_PART)} AS said FROM part")
def text_keyword_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, lambda x: segment.is_keyword(x, KEYWORDS), x=ONE_PART)


def split_sql(text: str) -> str:
    """DuckDB's line splitter: bullets go to the last fragment before them, which the joined text shows as its end."""
    return rf"""WITH l AS (SELECT p_partkey, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS pos FROM (SELECT p_partkey, {text} AS x FROM part)),
n AS (SELECT p_partkey, trim(line) AS line, pos FROM l WHERE trim(line) <> ''),
b AS (SELECT *, sum(CASE WHEN starts_with(line, '•') THEN 0 ELSE 1 END) OVER (PARTITION BY p_partkey ORDER BY pos) AS block FROM n),
h AS (SELECT *, list_filter(regexp_split_to_array(trim(regexp_replace(line, '\s*\([^)]*\)', '', 'g')), '[;,]'), lambda p: trim(p) <> '') AS p FROM b),
s AS (SELECT p_partkey, pos, block, CASE WHEN starts_with(line, '•') THEN chr(10) || line
  WHEN len(p) > 1 AND len(list_filter(p, lambda p: {is_known("p")})) = len(p) THEN array_to_string(list_transform(p, lambda p: regexp_replace(trim(p), '\.+$', '')), '|') ELSE line END AS w FROM h),
g AS (SELECT p_partkey, block, string_agg(w, '' ORDER BY pos) AS w FROM s GROUP BY p_partkey, block)
SELECT p_partkey, string_agg(w, '|' ORDER BY block) AS said FROM g GROUP BY p_partkey"""


LINES = """concat(CASE p_partkey % 4 WHEN 0 THEN 'Flying, vigilance; ward {2} (a, b).' WHEN 1 THEN 'Flying, fire' WHEN 2 THEN p_name ELSE 'haste;bushido 2.' END, chr(10), '  ', chr(10),
p_name, ' (x)', chr(10), '• ', p_type, chr(10), '• two', chr(10), 'Haste, protection from ', p_brand)"""


@query(split_sql(LINES))
def text_split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, lambda x: F.array_join(segment.split_lines(x, KEYWORDS), "|"), x=LINES)


ASKED = "concat(p_name, ' // flying, haste //', p_type, '//  // ', CASE WHEN p_partkey % 2 = 0 THEN 'ward {1}; cycling {2}' ELSE 'draw, then win' END)"


@query(split_sql(rf"regexp_replace({ASKED}, '\s*//\s*', chr(10), 'g')"))
def text_split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, lambda x: F.array_join(segment.split_query(x, KEYWORDS), "|"), x=ASKED)


COSTLY = "CASE p_partkey % 5 WHEN 0 THEN concat('Cycling {', p_size, '}{U} (It goes.)') WHEN 1 THEN 'Ward {3}.' WHEN 2 THEN 'Flying' WHEN 3 THEN concat(p_name, ' {2}') ELSE '(only this)' END"


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat('Cycling {', p_size, '}{U}. {', p_size, '}{U}, Discard this card: Draw a card.') WHEN 1 THEN 'Ward {3}. Counter it unless they pay {3}.'
WHEN 2 THEN 'Flying. It stays above.' END AS said FROM part"""
)
def text_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, lambda x: segment.expanded(x, TEMPLATES), x=COSTLY)


OVERLOADED = """concat('Return target ', p_name, '. Target it.', chr(10), CASE WHEN p_partkey % 3 = 0 THEN concat('Destroy target ', p_type, chr(10)) ELSE '' END,
CASE WHEN p_partkey % 2 = 0 THEN 'Overload {3} (Change it.)' ELSE 'Draw.' END)"""


@query(
    """WITH s AS (SELECT p_partkey, ['Return target ' || p_name || '. Target it.', CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN 'Overloaded — Return each ' || p_name || '. Each it.~Return each ' || p_name || '. Each it.' END,
CASE WHEN p_partkey % 3 = 0 THEN 'Destroy target ' || p_type END, CASE WHEN p_partkey % 2 = 0 THEN 'Overload {3} (Change it.)' ELSE 'Draw.' END] AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(list_filter(w, lambda x: x IS NOT NULL), lambda x: CASE WHEN contains(x, '~') THEN x ELSE x || '~' || x END), '|') AS said FROM s"""
)
def text_overload(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shown(x: Column) -> Column:
        return F.array_join(F.transform(segment.sources(x, KEYWORDS, {}), lambda s: F.concat(s["display"], F.lit("~"), s["source"])), "|")

    return said(spark, sf_dir, shown, x=OVERLOADED)


FACET_TEXT = """CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('{T}: Add {G}{G}. Put +1/+1 on it.', chr(10), 'Flying, vigilance, flying') WHEN 2 THEN concat('Ward {3}', chr(10), p_brand, ' deals ', p_size, ' damage.', chr(10), '(gone)')
ELSE concat(p_name, chr(10), p_type, chr(10), p_name) END"""
_BUILT = f"""WITH f AS (SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN [('', 'emptyoracle', false)]
WHEN 1 THEN [('{{T}}: Add {{G}}{{G}}. Put +1/+1 on it.', 'tap this card: Add two green mana. Put plus one strength and plus one toughness on it.', false), ('Flying', 'Flying. It stays above.', true), ('vigilance', 'vigilance.', true), ('flying', 'flying.', true)]
WHEN 2 THEN [('Ward {{3}}', 'Ward three generic mana. Counter it unless they pay three generic mana.', true), (p_brand || ' deals ' || p_size || ' damage.', 'this card deals ' || {word("p_size")} || ' damage.', false)]
ELSE [(p_name, p_name || '.', false), (p_type, p_type || '.', false)] END) AS r,
generate_subscripts(CASE p_partkey % 4 WHEN 0 THEN [1] WHEN 1 THEN [1, 2, 3, 4] ELSE [1, 2] END, 1) - 1 AS ix FROM part)
SELECT p_partkey AS entity_id, 0 AS facet_ix, ix::INTEGER AS fragment_ix, r[1] AS text, r[2] AS normalized, sha256(r[2]) AS text_hash, r[3] AS is_keyword FROM f"""


@query(_BUILT)
def fragment_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansion, normalization, hashing, removal of repeats, numbering, placeholders and the keyword flag together."""
    facets = parts(spark, sf_dir, text=FACET_TEXT).select(F.col("p_partkey").alias("entity_id"), F.lit(0).alias("facet_ix"), F.col("p_brand").alias("name"), F.lit("").alias("type_line"), "text")
    return frag.fragments(facets, KEYWORDS, TEMPLATES)


QUERY = "concat('draw with ', p_name, ' // flying, haste // (nothing) // draw with ', p_name)"


@query(
    f"""SELECT p_partkey, array_to_string(list_transform(['draw with ' || p_name, 'flying', 'haste'], lambda x: x || '~' || x || '.'), '|') AS said FROM part"""
)
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries without a reference to themselves have one variant; empty and repeated fragments go."""
    from ..operators.serve import query_parts

    return said(spark, sf_dir, lambda x: F.array_join(F.transform(query_parts(x, KEYWORDS, {}), lambda p: F.concat(p["display"], F.lit("~"), F.array_join(p["variants"], "/"))), "|"), x=QUERY)


# records

_FORMAT = "CASE p_partkey % 3 WHEN 0 THEN 'legal' WHEN 1 THEN 'not_legal' ELSE 'banned' END"


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a raw record with some of each reason to be skipped."""
    return parts(
        spark, sf_dir,
        oracle_id="CASE p_partkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_brand END", id="concat('r', p_partkey)", layout="CASE p_partkey % 11 WHEN 0 THEN 'token' WHEN 1 THEN 'art_series' ELSE 'normal' END",
        games="CASE p_partkey % 7 WHEN 0 THEN array('arena') WHEN 1 THEN NULL ELSE array('paper', 'arena') END", legalities=f"map('modern', {_FORMAT}, 'other', 'legal')",
        name="CASE WHEN p_partkey % 13 = 0 THEN concat(' A-', p_name) ELSE p_name END", type_line=TYPE_LINE,
        card_faces="CASE WHEN p_partkey % 5 = 0 THEN array(named_struct('name', p_name, 'type_line', 'Creature'), named_struct('name', p_type, 'type_line', CASE WHEN p_partkey % 10 = 0 THEN ' Card ' ELSE 'Land' END)) END",
        arena_id="CASE WHEN p_partkey % 4 = 0 THEN p_partkey END", multiverse_ids="CASE WHEN p_partkey % 8 = 0 THEN array() ELSE array(p_partkey) END", mtgo_id="CAST(NULL AS BIGINT)",
        tcgplayer_id="CASE WHEN p_partkey % 16 = 0 THEN p_partkey END", cardmarket_id="CAST(NULL AS BIGINT)",
        released_at="concat('20', lpad(CAST(p_size AS STRING), 2, '0'), '-01-01')", collector_number="CAST(p_partkey % 50 AS STRING)", ordinal="p_partkey",
    )


_KEPT = """coalesce(CASE p_partkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_brand END, '') <> '' AND p_partkey % 11 NOT IN (0, 1) AND NOT (p_partkey % 7 = 0 AND p_partkey % 3 = 1)
AND p_partkey % 13 <> 0 AND p_partkey % 10 <> 0 AND NOT (p_partkey % 8 = 0 AND p_partkey % 16 <> 0)"""


@query(f"SELECT p_partkey, 'r' || p_partkey AS id FROM part WHERE {_KEPT}")
def record_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.eligible(raw_records(spark, sf_dir)).select("p_partkey", "id")


@query(
    f"""SELECT p_brand AS oracle_id, 'r' || p_partkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey % 7 NOT IN (0, 1)) DESC, p_size, p_partkey % 50, p_partkey) AS n FROM part WHERE {_KEPT}) WHERE n = 1"""
)
def record_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold over each entity's records; the collector numbers here are numbers, so that an order says the same."""
    return records.best_records(records.eligible(raw_records(spark, sf_dir))).select("oracle_id", "id")


@query(
    f"""WITH w AS (SELECT p_partkey, string_split(lower(trim(string_split(coalesce({TYPE_LINE}, ''), '—')[1])), ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_filter(['artifact', 'creature', 'enchantment', 'instant', 'land', 'planeswalker', 'sorcery'], lambda x: list_contains(w, x)), ' ') AS said FROM w"""
)
def record_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, lambda t: F.array_join(records.type_categories(t), " "), t=TYPE_LINE)


@query("SELECT p_partkey, array_to_string(list_filter(['W', 'U', 'B', 'R', 'G'], lambda c: (p_size >> (instr('WUBRG', c) - 1)::INTEGER) & 1 = 1), '') AS said FROM part")
def record_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.filter(F.lit(["G", "W", "X", "R", "U", "B"]), lambda c: F.element_at(F.array(*(F.col("p_size").bitwiseAND(1 << k) > 0 for k in range(6))), F.instr(F.lit("WUBRGX"), c)))
    return parts(spark, sf_dir).select("p_partkey", records.color_identity(letters).alias("said"))


@query("SELECT p_partkey, (p_size & 31)::INTEGER AS said FROM part")
def bit_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.filter(F.lit(["G", "W", "R", "U", "B"]), lambda c: F.element_at(F.array(*(F.col("p_size").bitwiseAND(1 << k) > 0 for k in range(5))), F.instr(F.lit("WUBRG"), c)))
    return parts(spark, sf_dir).select("p_partkey", exprs.bit_set(letters, filters.COLORS).alias("said"))


@query(
    """SELECT p_partkey AS entity_id, 0 AS facet_ix, p_name AS name FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 0, p_name || '/1' FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 1, p_type || '/2' FROM part WHERE p_partkey % 5 = 0"""
)
def record_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    face = "named_struct('name', {}, 'mana_cost', '', 'type_line', 'Land', 'oracle_text', '', 'power', '', 'toughness', '', 'loyalty', '', 'defense', '', 'colors', array('W'))"
    rows = parts(
        spark, sf_dir, oracle_id="p_partkey", name="p_name", card_faces="CASE WHEN p_partkey % 5 = 0 THEN array({}, {}) END".format(face.format("concat(p_name, '/1')"), face.format("concat(p_type, '/2')")),
        **{c: "''" for c in ("mana_cost", "type_line", "oracle_text", "power", "toughness", "loyalty", "defense")}, colors="array('W')",
    )
    return records.facets(rows).select("entity_id", "facet_ix", "name")


@query("SELECT p_partkey FROM part WHERE len(list_intersect(string_split(p_name, ' '), ['red', 'bolt'])) > 0")
def filter_category_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).where(filters.any_category(F.split("p_name", " "), ["red", "bolt"])).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 = 1")
def filter_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir, legalities=f"CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 4 = 1 THEN map('modern', {_FORMAT}, 'legacy', CASE WHEN p_partkey % 4 = 1 THEN 'restricted' ELSE 'banned' END) END")
    return rows.where(filters.any_format(F.col("legalities"), ["modern", "legacy", "pauper"])).select("p_partkey")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#5') AND p_size <= 40 AND list_contains(string_split(p_name, ' '), 'red') AND (p_size & 2) = 2")
def filter_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of filters of a request in one predicate."""
    wanted = filters.Filters(categories=("red",), colors="U", cmc_max=40, rarities=("Brand#11", "Brand#23", "Brand#5"))
    rows = parts(spark, sf_dir, identity_mask="p_size & 31", cmc="p_size", rarity="p_brand", categories="split(p_name, ' ')")
    return rows.where(wanted.predicate()).select("p_partkey", "p_brand")


# columns


@query(
    """WITH c AS (SELECT p_partkey, unnest(string_split(p_name || p_name, '')) AS c, generate_subscripts(string_split(p_name || p_name, ''), 1) AS pos FROM (SELECT p_partkey, replace(p_name, 't', 'll') AS p_name FROM part)),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY p_partkey, c ORDER BY pos) AS run FROM c),
r AS (SELECT p_partkey, c, run, count(*) AS n, min(pos) AS pos FROM i GROUP BY p_partkey, c, run)
SELECT p_partkey, string_agg(c || n, '' ORDER BY pos) AS said FROM r GROUP BY p_partkey"""
)
def array_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    def runs(x: Column) -> Column:
        items = F.transform(F.split(x, ""), lambda c: F.struct(c.alias("c"), F.lit(1).cast("bigint").alias("n")))
        merged = exprs.run_lengths(items, lambda s: s["c"], lambda a, b: F.struct(a["c"].alias("c"), (a["n"] + b["n"]).alias("n")), "struct<c:string,n:bigint>")
        return F.array_join(F.transform(merged, lambda s: F.concat(s["c"], s["n"].cast("string"))), "")

    return said(spark, sf_dir, runs, x="concat(replace(p_name, 't', 'll'), replace(p_name, 't', 'll'))")


#: CRC-32 of a text in DuckDB, bit by bit.
CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]), lambda d, z: xor(d >> 1, 3988292384::UBIGINT * (d & 1)))), 4294967295::UBIGINT)"


def bag_sql(dimension: int) -> str:
    """Filled places and weighted sum of the bag-of-words vectors of u (text_hash, line)."""
    return f"""w AS (SELECT text_hash, unnest(regexp_extract_all(lower(line), '[a-z]+')) AS w FROM u),
k AS MATERIALIZED (SELECT w, {CRC.format("w")} % {dimension} AS slot FROM (SELECT DISTINCT w FROM w)),
c AS (SELECT text_hash, slot, count(*) AS n FROM w JOIN k USING (w) GROUP BY text_hash, slot),
v AS (SELECT text_hash, count(*) AS filled, sqrt(sum(n * n)) AS norm FROM c GROUP BY text_hash),
s AS (SELECT text_hash, sum((slot + 1) * (n / norm)::FLOAT::DOUBLE) AS s FROM c JOIN v USING (text_hash) GROUP BY text_hash)
SELECT u.text_hash, coalesce(filled, 0)::BIGINT AS filled, round(coalesce(s, 0), 2) AS weighted FROM u LEFT JOIN v USING (text_hash) LEFT JOIN s USING (text_hash)"""


def bags(encoded: DataFrame) -> DataFrame:
    places = F.transform("vector", lambda x, k: (k + 1) * x.cast("double"))
    filled = F.size(F.filter("vector", lambda x: x > 0)).cast("bigint")
    return encoded.select("text_hash", filled.alias("filled"), F.round(F.aggregate(places, F.lit(0.0), lambda a, x: a + x), 2).alias("weighted"))


@query(T + ", u AS (SELECT text_hash, any_value(line) AS line FROM l GROUP BY text_hash), " + bag_sql(512))
def hashing_encoder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bag-of-words vectors of all distinct lines in the default dimension, as the number of filled places and a weighted sum."""
    return bags(HashingEncoder().encode(frag.terms(lines(spark, sf_dir).select("text_hash", F.col("line").alias("normalized")))))


@query("WITH u AS (SELECT DISTINCT sha256(p_name) AS text_hash, p_name AS line FROM part), " + bag_sql(64))
def hashing_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for part names in 64 dimensions."""
    names = table(spark, sf_dir, "part").select(F.sha2("p_name", 256).alias("text_hash"), F.col("p_name").alias("normalized"))
    return bags(HashingEncoder(64).encode(frag.terms(names)))


@query(
    """WITH e AS (SELECT vec_id // 5 AS grp, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 5 <> 3),
m AS (SELECT grp, i, avg(x) AS x FROM e GROUP BY grp, i), n AS (SELECT grp, sqrt(sum(x * x)) AS norm FROM m GROUP BY grp)
SELECT grp, round(sum(i * x / norm), 6) AS weighted FROM m JOIN n USING (grp) GROUP BY grp"""
)
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five vectors as those of a text's tokens, of which the mask leaves out the fourth."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("grp"), "vec_id", F.col("embedding").alias("v"))
    texts = rows.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("t"))
    pooled = mean_pool(F.transform("t", lambda t: t["v"]), F.transform("t", lambda t: F.when(t["vec_id"] % 5 == 3, 0).otherwise(1)))
    return texts.select("grp", F.round(F.aggregate(F.transform(pooled, lambda x, k: (k + 1) * x), F.lit(0.0), lambda a, x: a + x), 6).alias("weighted"))
