r"""Personal data: patterns propose spans, checks confirm them, context words adjust the score.

DataFrame functions only. A pattern's places come from two views of one scan: split()
gives the texts between matches, regexp_extract_all() the matches; running lengths give
code point positions. Running sums and maxima over a document's matches are made by
doubling (n log n steps for n matches), and what surrounds a match comes from the
neighbouring views, so no step reads a text once per match. Patterns are written so that the regular expression engine never
looks at a run of characters twice (possessive repeats; a run is entered at its start),
with the same leftmost, non-overlapping matches as their plain forms:

* email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`
* ip `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`, parts at most 255
* card `[0-9]([\x20-]?[0-9])+`, 13 to 19 digits that pass Luhn's check
* phone `\+[0-9][\x20().0-9-]+[0-9]`, 9 to 15 digits

These are the base spans; all of them stay. The method adds, outside base spans:

* iban: an international bank account number that passes the mod-97 check
* phone: a number in national form (3, 3 and 4 digits), if a word such as "phone" or
  "Telefon" stands shortly before or after it

Every span has a score from 0 to 1: what its pattern and checks are worth, and more for
context words of its kind in the 40 characters before, other spans among them, or the 20 after. Added spans need ACCEPTED.

Results for special inputs: a null text counts as empty, and has no spans; redact()
keeps it null. Repeated rows each give a row, an empty table an empty one. Extra
columns are ignored by find(), and kept by redact() whatever their names. Texts are
scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import id_and_text

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Context words near a span, in English, German, French and Spanish.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write to|kontakt|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|direcci)",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|kreditkarte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|handy|t[eé]l[eé]phone|portable|tel[eé]fono|m[oó]vil)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
}
KINDS = ["email", "ip", "card", "phone", "iban"]
#: What a pattern with its checks is worth, what context adds, and what added spans need.
WORTH = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "national": 0.4}
CONTEXT_WORTH, ACCEPTED, CONTEXT_CHARS, AFTER_CHARS = 0.25, 0.6, 40, 20

FOUND = "array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>"
#: Matches beside one that its context can reach into: none is shorter than 4 characters.
BEFORE_HITS, AFTER_HITS = -(-CONTEXT_CHARS // 4), -(-AFTER_CHARS // 4)
#: Code points of one piece of a text that is cut up for redaction.
CUT = 512


def _running(values: Column, pick, none: Column) -> Column:
    """values[i] combined with all before it by pick, a function of two columns, by doubling."""
    rounds = F.length(F.bin(F.size(values).cast("long") - 1))
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), rounds - 1)).otherwise(F.array().cast("array<int>"))

    def double(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda v, i: pick(v, F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), none)))

    return F.aggregate(steps, values, double)


def _running_sum(values: Column) -> Column:
    return _running(values, lambda x, y: x + y, F.lit(0).cast("long"))


def _running_max(values: Column) -> Column:
    return _running(values, F.greatest, F.lit(-1).cast("long"))


def _with_found(df: DataFrame, text: Column, pattern: str, out: str) -> DataFrame:
    """df with column out: places, matches and the characters around them, of all matches."""
    pairs, ends = f"{out}_pairs", f"{out}_ends"
    long = lambda x: F.length(x).cast("long")
    both = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda gap, hit: F.struct(
            long(gap).alias("gap"), F.coalesce(long(hit), F.lit(0).cast("long")).alias("n"), hit.alias("hit"), F.right(F.concat(gap, F.lit("")), F.lit(CONTEXT_CHARS)).alias("last"), F.left(gap, F.lit(AFTER_CHARS)).alias("first")
        ),
    )
    empty = "array<struct<gap:bigint,n:bigint,hit:string,last:string,first:string>>"
    df = df.withColumn(pairs, F.when(text.rlike(pattern), both).otherwise(F.array().cast(empty)))
    p = F.col(pairs)
    df = df.withColumn(ends, _running_sum(F.transform(p, lambda x: x["gap"] + x["n"])))

    def one(z: Column, i: Column) -> Column:
        x, end = z[pairs], z[ends]
        low = F.greatest(F.lit(0), i - BEFORE_HITS)
        back = F.transform(F.slice(p, low + 1, i - low), lambda y: F.concat(y["last"], F.coalesce(y["hit"], F.lit(""))))
        ahead = F.transform(F.slice(p, i + 2, F.lit(AFTER_HITS + 1)), lambda y: F.concat(y["first"], F.coalesce(y["hit"], F.lit(""))))
        before = F.right(F.concat(F.array_join(back, ""), x["last"]), F.lit(CONTEXT_CHARS))
        after = F.left(F.array_join(ahead, ""), F.lit(AFTER_CHARS))
        return F.when(x["hit"].isNotNull(), F.struct((end - x["n"]).alias("start"), end.alias("end"), x["hit"].alias("hit"), before.alias("before"), after.alias("after")))

    return df.withColumn(out, F.filter(F.transform(F.arrays_zip(p, F.col(ends)), one), lambda x: x.isNotNull())).drop(pairs, ends)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""

    def value(i: Column) -> Column:
        d = F.ascii(F.substr(digits, -i, F.lit(1))) - 48
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """The check of an account number without spaces: letters as 10 to 35, first four at the end, remainder 1."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c <= 57, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _spans(found: Column, kind: str, worth: str, base: bool) -> Column:
    def span(x: Column) -> Column:
        more = F.when(x["before"].rlike(CONTEXT[kind]) | x["after"].rlike(CONTEXT[kind]), CONTEXT_WORTH).otherwise(0.0)
        return F.struct(F.lit(KINDS.index(kind)).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.least(F.lit(1.0), F.lit(WORTH[worth]) + more).alias("score"), F.lit(base).alias("base"))

    return F.transform(found, span)


def span_arrays(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column out: its text column's spans (rank, start, end, kind, score, base) by kind, then start."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = lambda x: F.length(_digits(x["hit"]))
    held = {name: f"{out}_{name}" for name in ("email", "ip", "card", "phone", "iban", "national", "base", "added", "all", "ends", "starts")}
    rows = df
    for name, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("iban", IBAN), ("national", NATIONAL)):
        rows = _with_found(rows, t, pattern, held[name])
    found = {name: F.col(c) for name, c in held.items()}
    ip = F.filter(found["ip"], lambda x: x["hit"].rlike(f"^{PART}(?:\\.{PART}){{3}}$"))
    card = F.filter(found["card"], lambda x: n(x).between(13, 19) & luhn(_digits(x["hit"])))
    phone = F.filter(found["phone"], lambda x: n(x).between(9, 15))
    iban = F.filter(found["iban"], lambda x: mod97(F.replace(x["hit"], F.lit(" "), F.lit(""))))
    base = F.concat(_spans(found["email"], "email", "email", True), _spans(ip, "ip", "ip", True), _spans(card, "card", "card", True), _spans(phone, "phone", "phone", True))
    added = F.concat(_spans(iban, "iban", "iban", False), _spans(found["national"], "phone", "national", False))
    rows = rows.withColumns({held["base"]: base, held["added"]: F.filter(added, lambda x: x["score"] >= ACCEPTED)})
    # In order of starts, an added span is free if all base spans before it end before it, and the next one begins after it.
    line = F.array_sort(F.transform(F.concat(found["base"], found["added"]), lambda x: F.struct(x["start"].alias("at"), (~x["base"]).alias("late"), x.alias("span"))))
    rows = rows.withColumn(held["all"], F.when(F.size(found["added"]) > 0, line))
    every = found["all"]
    far = F.lit(1 << 62).cast("long")
    ends = _running_max(F.transform(every, lambda x: F.when(x["span"]["base"], x["span"]["end"]).otherwise(F.lit(-1).cast("long"))))
    # Running maxima from the end, of negative starts: the next base span's start.
    starts = F.reverse(_running(F.transform(F.reverse(every), lambda x: F.when(x["span"]["base"], -x["at"]).otherwise(-far)), F.greatest, -far))
    rows = rows.withColumns({held["ends"]: ends, held["starts"]: starts})
    span = lambda z: z[held["all"]]["span"]
    free = F.filter(F.arrays_zip(every, found["ends"], found["starts"]), lambda z: ~span(z)["base"] & (z[held["ends"]] <= span(z)["start"]) & (-z[held["starts"]] >= span(z)["end"]))
    spans = F.when(every.isNull(), found["base"]).otherwise(F.concat(found["base"], F.transform(free, span)))
    return rows.withColumn(out, F.array_sort(spans)).drop(*held.values())


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: every document's spans by kind, then start."""
    return span_arrays(id_and_text(df, id_col, text_col), "text", "spans").select("doc_id", "spans")


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans (kind:start:end, comma-joined)."""
    found = find(df, id_col, text_col)
    base = F.filter("spans", lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with every span of its texts replaced by its kind, such as [EMAIL].

    Overlapping spans become one, named after the first, of those the longest. length_col, if df has it, gets
    the new number of code points.
    """
    held = "__pii"
    while any(c.lower().startswith(held) for c in df.columns):
        held += "_"
    text = F.col(text_col)
    line, ends, cuts = f"{held}_line", f"{held}_until", f"{held}_cuts"
    order = F.array_sort(F.transform(F.col(held), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["end"].alias("end"), x["kind"].alias("kind"))))
    rows = span_arrays(df, text_col, held).withColumn(line, order)
    # Where the spans before each one end, and where all end.
    before = F.concat(F.array(F.lit(0).cast("long")), _running_max(F.transform(F.col(line), lambda x: x["end"])))
    rows = rows.withColumns({ends: before, cuts: F.when(F.size(held) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), 0))})

    def part(low: Column, high: Column) -> Column:
        """The text from low to high, from the pieces it lies in."""
        first, last = F.floor(low / CUT).cast("int"), F.floor(high / CUT).cast("int")
        pieces = F.array_join(F.slice(F.col(cuts), first + 1, last - first + 1), "")
        return F.substr(pieces, (low - F.lit(CUT) * first + 1).cast("int"), (high - low).cast("int"))

    def step(z: Column) -> Column:
        x, until = z[line], z[ends]
        # A span that begins inside an earlier one gives nothing of its own.
        return F.when(x.isNull() | (x["start"] < until), "").otherwise(F.concat(part(until, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))

    parts = F.transform(F.arrays_zip(F.col(line), F.col(ends)), step)  # there is one end more than spans
    tail = part(F.element_at(F.col(ends), -1), F.length(text).cast("long"))
    rows = rows.withColumn(text_col, F.when(F.size(held) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(text)).drop(held, line, ends, cuts)
    if length_col and length_col in df.columns:
        rows = rows.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType))
    return rows.select(*df.columns)
