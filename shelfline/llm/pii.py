"""Personal data: patterns propose spans, checksums confirm them, words around them move their score.

DataFrame operations only. Places come from the lengths of what stands between a pattern's matches
and of the matches themselves, added up; no character is looked at twice for it.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spelling import LOWER, UPPER

#: Code points before and after a span that count as its context; other matches of its pattern end it.
BEFORE, AFTER = 40, 20
#: What a word of a kind nearby adds, what a word that speaks against it takes, and the score from which a span counts.
WORD, DOUBT, ENOUGH = 0.3, 0.3, 0.5
#: Letters of an IBAN by country.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: Patterns. What is possessive or looks behind only spares the matcher from trying again what cannot fit.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
HYPHENED = r"(?<![0-9])[0-9]++(?:-[0-9]++)++"
IP_PARTS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether digits pass Luhn's check."""
    twice = lambda c, i: (F.ascii(c) - 48) * (1 + i % 2)
    values = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(twice(c, i) > 9, twice(c, i) - 9).otherwise(twice(c, i)))
    return F.aggregate(values, F.lit(0), lambda t, v: t + v) % 10 == 0


def mod97(code: Column) -> Column:
    """The remainder by 97 of an IBAN without spaces, its first four signs moved to the end and letters read as 10 to 35."""
    add = lambda t, c: F.when(c < "A", t * 10 + F.ascii(c) - 48).otherwise(t * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4)), ""), F.lit(0), add)


def iban_of(m: Column) -> Column:
    """The IBAN that a match is, or is without its last group; else null."""
    sizes = F.create_map(*[F.lit(x) for pair in IBAN_SIZES.items() for x in pair])
    right = lambda s: (F.length(F.replace(s, F.lit(" "), F.lit(""))) == F.try_element_at(sizes, F.substring(s, 1, 2))) & (mod97(F.replace(s, F.lit(" "), F.lit(""))) == 1)
    less = F.regexp_replace(m, " [A-Z0-9]{1,3}$", "")
    return F.when(right(m), m).when(right(less), less)


def card_of(m: Column, least: int, most: int) -> Column:
    return F.when((F.length(m) >= least) & F.length(digits(m)).between(least, most), F.when(luhn(digits(m)), m))


#: Kinds in the order of results: name, pattern, what it needs to contain, the span of a match or null, score before
#: context, whether it counts in any case, words for and against it.
KINDS: list[tuple[str, str, str, Callable[[Column], Column], float, bool, str, str]] = [
    ("email", EMAIL, "@", lambda m: m, 0.8, True, "mail|email|contact|write|schreib|correo|courriel", "noreply|postmaster"),
    ("ip", IP, ".", lambda m: F.when(m.rlike(IP_PARTS), m), 0.6, True, "ip|address|server|host|client|login", "version|section|release"),
    ("card", CARD, "", lambda m: card_of(m, 16, 19), 0.7, True, "card|visa|master|credit|debit|karte|tarjeta|carte|payment", "order|tracking|serial|isbn"),
    ("phone", PHONE, "+", lambda m: F.when(F.length(digits(m)).between(8, 15), m), 0.6, True, "phone|tel|telefon|call|mobile|fax", "formula|equals"),
    ("iban", IBAN, "", iban_of, 0.8, False, "iban|bank|account|konto|cuenta|compte|transfer", "example|sample"),
    ("ssn", HYPHENED, "-", lambda m: F.when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), m), 0.3, False, "ssn|social|security|taxpayer|insurance", "part|serial|order"),
    ("card_short", CARD, "", lambda m: F.when(digits(m).rlike("^(?:3[47][0-9]{13}|3[068][0-9]{12}|4[0-9]{12})$"), card_of(m, 13, 15)), 0.3, False, "card|visa|amex|diners|credit|debit|karte|tarjeta|carte", "order|tracking|serial|isbn"),
]


def bind(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once."""
    return F.get(F.transform(F.array(c), use), 0)


def running(values: Column) -> Column:
    """Sums of all values before each, in blocks of about the root of their number, so that no long array is copied for each value."""

    def scan(v: Column) -> Column:
        return F.aggregate(v, F.array(F.lit(0).cast("long")), lambda t, x: F.concat(t, F.array(F.element_at(t, -1) + x)))

    def blocks(v: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(v), block), lambda i: F.slice(v, i, block))

    def sums(parts: Column) -> Column:
        before = scan(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda t, x: t + x)))
        return bind(before, lambda b: F.flatten(F.transform(parts, lambda p, k: F.transform(F.slice(scan(p), 1, F.size(p)), lambda x: x + F.get(b, k)))))

    return F.when(F.size(values) > 0, bind(values, lambda v: bind(blocks(v), sums))).otherwise(F.array().cast("array<bigint>"))


def context_score(before: Column, after: Column, prior: float, words: str, against: str) -> Column:
    """The score of a span between two texts, 0 to 1."""
    near = F.translate(F.concat(F.substring(before, -BEFORE, BEFORE), F.lit(" "), F.substring(after, 1, AFTER)), UPPER, LOWER)
    says = lambda some: near.rlike(f"(?:^|[^a-z])(?:{some})(?:[^a-z]|$)").cast("int")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), prior + WORD * says(words) - DOUBT * says(against)))


def spans(text: Column, matches: Column, kind: str, pattern: str, span: Callable[[Column], Column], prior: float, base: bool, words: str, against: str) -> Column:
    """A pattern's confirmed matches as structs kind, start, end, score, base."""

    def placed(between: Column) -> Column:
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: (F.length(b) + F.length(m)).cast("long"))

        def one(at: Column, m: Column, i: Column) -> Column:
            start = F.get(at, i) + F.length(F.get(between, i))
            score = context_score(F.get(between, i), F.get(between, i + 1), prior, words, against)
            return bind(span(m), lambda s: F.when(s.isNotNull(), F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(s)).alias("end"), score.alias("score"), F.lit(base).alias("base"))))

        every = bind(running(steps), lambda at: F.transform(matches, lambda m, i: one(at, m, i)))
        return F.filter(every, lambda x: x.isNotNull() & (x["base"] | (x["score"] >= ENOUGH)))

    some = F.exists(matches, lambda m: span(m).isNotNull())
    return F.when(some, bind(F.split(text, pattern, -1), placed)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: double, base: boolean>>"


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `found` (in place of one of that name): kind, start, end, score, base of each span, by kind as in KINDS, then start.

    Places count code points, the end exclusive. Base kinds count whatever their score, others from ENOUGH on. Matches of one
    pattern are leftmost and don't overlap, and one that fails its check is dropped without another try; spans of different
    kinds may overlap. Null and empty texts have none. Rows stay as they are, repeated ones too, and nothing is shuffled.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "found"]).alias("_row")
    patterns = {p: (f"_m{i}", need) for i, (p, need) in enumerate(dict((k[1], k[2]) for k in KINDS).items())}
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(kept, whole.alias("_text"))
    none = F.array().cast("array<string>")
    every = lambda p: F.regexp_extract_all("_text", F.lit(p), F.lit(0))
    rows = rows.select("*", *[(F.when(F.contains(F.col("_text"), F.lit(need)), every(p)).otherwise(none) if need else every(p)).alias(name) for p, (name, need) in patterns.items()])
    parts = [spans(F.col("_text"), F.col(patterns[p][0]), kind, p, span, prior, base, words, against) for kind, p, _, span, prior, base, words, against in KINDS]
    return rows.select("_row.*", F.concat(*parts).alias("found"))


def written(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs).select("doc_id", "found", F.filter("found", lambda x: x["base"]).alias("own"))
    count = lambda kind: F.size(F.filter("own", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(written(F.col("own")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def _sql() -> str:
    """The same in SQL; its matcher needs no help against repeated tries."""
    plain = {EMAIL: "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", IP: "[0-9]+(?:[.][0-9]+){3}", CARD: "[0-9](?:[ -]?[0-9])+", PHONE: "[+][0-9][ ().0-9-]+[0-9]", IBAN: IBAN, HYPHENED: "[0-9]+(?:-[0-9]+)+"}
    digits_ = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_ = f"list_sum(list_transform(range(length({digits_})), lambda k: CASE WHEN (length({digits_}) - k) % 2 = 0 THEN (2 * CAST({digits_}[k + 1] AS INT)) // 10 + (2 * CAST({digits_}[k + 1] AS INT)) % 10 ELSE CAST({digits_}[k + 1] AS INT) END)) % 10 = 0"
    sizes = f"MAP {{{', '.join(f'{k!r}: {v}' for k, v in IBAN_SIZES.items())}}}"
    code = "replace({0}, ' ', '')"
    mod = f"list_reduce(list_prepend(0, list_transform(string_split(substr({code}, 5) || substr({code}, 1, 4), ''), lambda c: unicode(c))), lambda t, c: CASE WHEN c < 65 THEN t * 10 + c - 48 ELSE t * 100 + c - 55 END % 97)"
    right = f"coalesce(length({code}) = {sizes}[substr({{0}}, 1, 2)], false) AND CASE WHEN length({{0}}) >= 8 THEN {mod} = 1 END"
    less = "regexp_replace(m, ' [A-Z0-9]{1,3}$', '')"
    iban = f"CASE WHEN {right.replace('{0}', 'm')} THEN m WHEN {right.replace('{0}', less)} THEN {less} END"
    spans_ = {
        "email": "m",
        "ip": "CASE WHEN list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND TRY_CAST('0' || ltrim(x, '0') AS INT) <= 255)) THEN m END",
        "card": f"CASE WHEN length({digits_}) BETWEEN 16 AND 19 AND {luhn_} THEN m END",
        "phone": f"CASE WHEN length({digits_}) BETWEEN 8 AND 15 THEN m END",
        "iban": iban,
        "ssn": "CASE WHEN regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND substr(m, 1, 3) NOT IN ('000', '666') AND m[1] <> '9' AND substr(m, 5, 2) <> '00' AND substr(m, 8) <> '0000' THEN m END",
        "card_short": f"CASE WHEN regexp_full_match({digits_}, '3[47][0-9]{{13}}|3[068][0-9]{{12}}|4[0-9]{{12}}') AND {luhn_} THEN m END",
    }
    says = lambda some: f"CAST(regexp_matches(near, '(?:^|[^a-z])(?:{some})(?:[^a-z]|$)') AS INT)"
    parts = []
    for i, (kind, pattern, _, _, prior, base, words, against) in enumerate(KINDS):
        parts.append(f"""SELECT doc, {i} AS k, '{kind}' AS kind, start, start + length(s) AS stop, {base} AS base FROM (
  SELECT *, {spans_[kind]} AS s FROM (SELECT doc, ms[i + 1] AS m,
    CAST(coalesce(list_sum(list_transform(ms[1:i] || bs[1:i + 1], lambda x: length(x))), 0) AS BIGINT) AS start,
    translate(right(bs[i + 1], {BEFORE}) || ' ' || left(bs[i + 2], {AFTER}), '{UPPER}', '{LOWER}') AS near
    FROM (SELECT doc, ms, string_split_regex(text, '{plain[pattern]}') AS bs, unnest(range(len(ms))) AS i FROM (SELECT doc, text, regexp_extract_all(text, '{plain[pattern]}') AS ms FROM docs))))
  WHERE s IS NOT NULL AND ({base} OR {prior} + {WORD} * {says(words)} - {DOUBT} * {says(against)} >= {ENOUGH})""")
    union = "\nUNION ALL\n".join(parts)
    count = lambda kind: f"count(*) FILTER (kind = '{kind}') AS n_{kind}"
    said = "kind || ':' || start || ':' || stop, ',' ORDER BY k, start"
    return f"""WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents), found AS (
{union}
) SELECT any_value(doc_id) AS doc_id, {', '.join(count(k) for k in ('email', 'ip', 'card', 'phone'))}, sha256(coalesce(string_agg({said}) FILTER (base), '')) AS base_sha256, coalesce(string_agg({said}) FILTER (kind IS NOT NULL), '') AS spans
FROM docs LEFT JOIN found USING (doc) GROUP BY doc"""


OP11_SQL = _sql()
