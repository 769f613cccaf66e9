"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find emails, addresses, cards and phone numbers, the seeds. Candidates are words that
hold a digit or an @, and runs of up to RUN such words with single blanks between, where no base span
lies. Seeds and candidates are instances; what surrounds an instance are its lexical patterns: the
word to its left, the two to its left, the one to its right, both neighbours, and its own form
(digits as 9, letters as a). In rounds, a pattern is scored by the share and number of trusted
instances among the distinct ones that it extracts, an instance by the patterns that extract it.
Patterns of high confidence then mark candidates that no base pattern matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, materialize

#: The base patterns, written so that no search is quadratic and no group recurses.
#: A match may begin only where a run begins or where the match before ended, which is where the
#: leftmost match begins anyway.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(BASE)
#: A document without this character has no match.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Words that hold a digit or an @, between blanks and signs that set values apart.
_APART = r"\s:=\"',;<>|\[\]{}"
_ATOM = rf"(?<![^{_APART}])[^{_APART}0-9@]*+[0-9@][^{_APART}]*+"
#: Words of an instance at most, and matches that one step of a running sum copies.
RUN, STEP = 4, 256
_NO_SPANS = "array<struct<kind:string,start:int,end:int,context:boolean>>"
#: Code points of the pieces from which a masked text is put together.
PIECE = 4096


_SPAN = "array<struct<start:int,end:int,hit:string,gap:string,next:string>>"


def _spans(hits: str, gaps: str) -> Column:
    """(start, end, hit, gap, next) of each match, from the matches and the texts between them (code points).

    The running sum goes by steps of STEP matches, so that a text full of matches is not copied per match.
    """
    step = f"""aggregate(slice(items, j * {STEP} + 1, {STEP}), named_struct('at', 0, 'out', CAST(array() AS {_SPAN})),
        (s, x) -> named_struct('at', s.at + length(x.gap) + length(x.hit), 'out', array_append(s.out,
            named_struct('start', s.at + length(x.gap), 'end', s.at + length(x.gap) + length(x.hit), 'hit', x.hit, 'gap', x.gap, 'next', x.next))))"""
    places = "aggregate(parts, named_struct('at', 0, 'out', CAST(array() AS array<int>)), (s, b) -> named_struct('at', s.at + b.at, 'out', array_append(s.out, s.at)), s -> s.out)"
    moved = "flatten(zip_with(parts, PLACES, (b, p) -> transform(b.out, x -> named_struct('start', x.start + p, 'end', x.end + p, 'hit', x.hit, 'gap', x.gap, 'next', x.next))))".replace("PLACES", places)
    items = f"zip_with(zip_with({hits}, slice({gaps}, 1, size({hits})), (h, g) -> named_struct('hit', h, 'gap', g)), slice({gaps}, 2, size({hits})), (x, n) -> named_struct('hit', x.hit, 'gap', x.gap, 'next', n))"
    return F.expr(
        f"""CASE WHEN size({hits}) = 0 THEN CAST(array() AS {_SPAN}) ELSE element_at(transform(
            transform(array({items}), items -> transform(sequence(0, CAST((size(items) - 1) DIV {STEP} AS int)), j -> {step})), parts -> {moved}), 1) END"""
    )


def _first_beyond(items: str, field: str, bound: str) -> str:
    """Place of the first of items, sorted by field, whose field is over bound (their number if none is), by halving."""
    return f"""aggregate(sequence(1, length(bin(size({items})))), named_struct('lo', 0, 'hi', size({items})), (s, step) -> IF(s.lo >= s.hi, s,
        IF(get({items}, shiftright(s.lo + s.hi, 1)).{field} > {bound}, named_struct('lo', s.lo, 'hi', shiftright(s.lo + s.hi, 1)), named_struct('lo', shiftright(s.lo + s.hi, 1) + 1, 'hi', s.hi))), s -> s.lo)"""


def _scan(items: str, kind: str, at: str, made: str) -> str:
    """Struct of at, after all of items (x), and out, what they made on the way; by steps of STEP, so that out is not copied per item.

    at and made are of the state s.at and x; made is null where x makes nothing. kind is the type of out.
    """
    step = f"""aggregate(slice({items}, j * {STEP} + 1, {STEP}), named_struct('at', t.at, 'out', CAST(array() AS {kind})), (s, x) -> named_struct('at', {at}, 'out', IF({made} IS NULL, s.out, array_append(s.out, {made}))))"""
    return f"""aggregate(IF(size({items}) > 0, sequence(0, CAST((size({items}) - 1) DIV {STEP} AS int)), CAST(array() AS array<int>)), named_struct('at', 0, 'parts', CAST(array() AS array<{kind}>)),
        (t, j) -> element_at(transform(array({step}), r -> named_struct('at', r.at, 'parts', array_append(t.parts, r.out))), 1), t -> named_struct('at', t.at, 'out', flatten(t.parts)))"""


def _valid(kind: str, x: Column) -> Column:
    hit = x["hit"]
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        back = F.reverse(digits)
        double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        total = F.aggregate(
            F.sequence(F.lit(1), F.length(digits)), F.lit(0),
            lambda s, i: s + F.when(i % 2 == 1, back.substr(i, F.lit(1)).cast("int")).otherwise(double(back.substr(i, F.lit(1)).cast("int"))),
        )
        return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda x: _valid(kind, x)


def with_base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __text (null: empty) and, per kind, __<kind>: array of (start, end, hit). Names of docs must not begin so."""
    out = docs.withColumn("__text", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    raw, found, done = {}, {}, {}
    for kind, pattern in BASE.items():
        need = F.col("__text").rlike("[0-9]{1}[ -]?[0-9]") if _NEEDS[kind] is None else F.contains("__text", F.lit(_NEEDS[kind]))
        raw[f"__{kind}_hits"] = F.when(need, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = out.withColumns(raw)
    for kind, pattern in BASE.items():
        found[f"__{kind}_gaps"] = F.when(F.size(f"__{kind}_hits") > 0, F.split("__text", pattern, -1)).otherwise(F.array().cast("array<string>"))
    out = out.withColumns(found)
    for kind in KINDS:
        done[f"__{kind}"] = _spans(f"__{kind}_hits", f"__{kind}_gaps")
    out = out.withColumns(done).drop(*raw, *found)
    short = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"))
    return out.withColumns({f"__{kind}": F.transform(F.filter(f"__{kind}", _checked(kind)), short) for kind in KINDS})


def _named(rows: DataFrame) -> DataFrame:
    """rows with two hashes of id and text: rows that repeat both share their findings."""
    return rows.withColumns({"k1": F.xxhash64("doc_id", "__text"), "k2": F.hash("__text", "doc_id")})


def form(word: Column) -> Column:
    """Digits as 9, runs of letters as a, all else as it is."""
    return F.regexp_replace(F.regexp_replace(word, "[0-9]", "9"), r"\p{L}++", "a")


class ContextualPII:
    """least: distinct trusted instances that a pattern needs; trust: confidence from which patterns
    and instances are believed; rounds: of scoring both; slack: digits that a found instance may
    have more than the longest seed of its kind, or fewer than the shortest."""

    def __init__(self, least: int = 3, trust: float = 0.9, rounds: int = 2, slack: int = 3):
        self.least, self.trust, self.rounds, self.slack = least, trust, rounds, slack

    def identifiers(self, based: DataFrame) -> DataFrame:
        """(k1, k2, start, end, word, seed, patterns): seeds with their kind, and candidates (no seed).

        based: doc_id and the columns of with_base_spans.
        """
        rows = _named(based.where(F.col("__text").rlike("[0-9@]")))
        rows = rows.withColumn("hits", F.regexp_extract_all("__text", F.lit(_ATOM), F.lit(0))).withColumn("gaps", F.split("__text", _ATOM, -1)).withColumn("atoms", _spans("hits", "gaps"))
        rows = rows.select("k1", "k2", "atoms", *[f"__{k}" for k in KINDS])
        over = " OR ".join(f"(size(__{k}) > 0 AND coalesce(get(__{k}, {_first_beyond(f'__{k}', 'end', 'x.a.start')}).start < x.a.end, false))" for k in KINDS)
        # An atom without the signs at its ends; bare: nothing was cut there; free: no base span lies in it.
        # Spans of a kind, and atoms, are sorted and apart, so that what overlaps is found by halving.
        rows = rows.withColumn("atoms", F.expr(
            r"""transform(transform(atoms, a -> named_struct('a', a, 'lead', length(regexp_extract(a.hit, '^[^\\p{L}0-9+(]*+', 0)), 'tail', length(regexp_extract(a.hit, '(?<![^\\p{L}0-9)])[^\\p{L}0-9)]++$', 0)))),
                x -> named_struct('start', x.a.start + x.lead, 'end', greatest(x.a.start + x.lead, x.a.end - x.tail), 'hit', substring(x.a.hit, x.lead + 1, greatest(0, length(x.a.hit) - x.lead - x.tail)),
                    'from', x.a.start, 'to', x.a.end, 'whole', x.a.hit, 'gap', x.a.gap, 'next', x.a.next, 'bare_left', x.lead = 0, 'bare_right', x.tail = 0,
                    'free', NOT (OVER)))""".replace("OVER", over)
        ))
        base = "concat(" + ", ".join(f"transform(__{k}, b -> named_struct('start', b.start, 'end', b.end, 'hit', b.hit, 'kind', '{k}'))" for k in KINDS) + ")"
        joined = """transform(atoms, (a, i) -> named_struct('a', a, 'on', coalesce(i > 0 AND a.free AND a.gap = ' ' AND a.bare_left AND get(atoms, i - 1).free AND get(atoms, i - 1).bare_right, false)))"""
        runs = f"""flatten(transform(linked, (x, i) -> transform(filter(sequence(0, {RUN - 1}), w -> x.a.free AND x.a.hit <> '' AND i + w < size(linked) AND forall(slice(linked, i + 2, w), y -> y.on)),
            w -> named_struct('start', x.a.start, 'end', get(linked, i + w).a.end, 'word', array_join(transform(slice(linked, i + 1, w + 1), y -> y.a.hit), ' '), 'seed', CAST(NULL AS string),
                'left', x.a.gap, 'right', get(linked, i + w).a.next))))"""
        first, last = _first_beyond("atoms", "to", "b.start"), f"{_first_beyond('atoms', 'from', 'b.end - 1')} - 1"
        seeds = f"""transform(transform({base}, b -> named_struct('b', b, 'first', get(atoms, {first}), 'last', get(atoms, {last}))), x -> named_struct('start', x.b.start, 'end', x.b.end, 'word', x.b.hit, 'seed', x.b.kind,
            'left', concat(x.first.gap, substring(x.first.whole, 1, greatest(0, x.b.start - x.first.from))),
            'right', concat(substring(x.last.whole, greatest(0, x.b.end - x.last.from) + 1), x.last.next)))"""
        rows = rows.withColumn("linked", F.expr(joined)).select("k1", "k2", F.explode(F.concat(F.expr(seeds), F.expr(runs))).alias("x"))
        rows = rows.select("k1", "k2", "x.start", "x.end", F.lower("x.word").alias("word"), "x.seed", F.lower("x.left").alias("left"), F.lower("x.right").alias("right"))
        word, before = r"(\p{L}++)[^\p{L}]*+$", r"(\p{L}++)[^\p{L}]++\p{L}++[^\p{L}]*+$"
        start = r"(?<!\p{L})"
        rows = rows.withColumns({"l": F.regexp_extract("left", start + word, 1), "ll": F.regexp_extract("left", start + before, 1), "r": F.regexp_extract("right", r"^[^\p{L}]*+(\p{L}++)", 1), "f": form(F.col("word"))})
        l, ll, r, name = F.col("l"), F.col("ll"), F.col("r"), lambda kind, *parts: F.concat(F.lit(f"{kind}: "), F.concat_ws(" ", *parts))
        patterns = F.array(F.when(l != "", name("left", l)), F.when(ll != "", name("two left", ll, l)), F.when(r != "", name("right", r)), F.when((l != "") & (r != ""), name("around", l, r)), name("form", F.col("f")))
        return rows.select("k1", "k2", "start", "end", "word", "seed", F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"))

    @staticmethod
    def _beside(table: DataFrame, width: int) -> DataFrame:
        """table, broadcast if its rows of about `width` bytes are few; else it is joined by shuffle."""
        return F.broadcast(table) if table.count() <= BROADCAST_IDS * 8 // width else table

    @staticmethod
    def profiles(words: DataFrame) -> DataFrame:
        """Per kind what its seeds are made of: the fewest and most digits, whether with letters, with an @."""
        digits, letters, at = (F.length(F.regexp_replace("word", p, "")) for p in ("[^0-9]", r"[^\p{L}]", "[^@]"))
        made = words.select("seed", "word", digits.alias("digits"), (letters > 0).cast("int").alias("letters"), (at > 0).cast("int").alias("at"))
        return made.where("seed IS NOT NULL").groupBy(F.col("seed").alias("kind")).agg(F.min("digits").alias("least_digits"), F.max("digits").alias("most_digits"), F.min("letters").alias("least_letters"), F.max("letters").alias("most_letters"), F.min("at").alias("least_at"), F.max("at").alias("most_at"))

    def patterns(self, words: DataFrame) -> DataFrame:
        """(pattern, kind, confidence, least_..., most_...) of the believed patterns.

        Confidence is the share of trusted ones among the distinct instances, times 1 - 2^-number.
        """
        profiles = materialize(self.profiles(words))
        every = words.select("word", "seed", F.explode("patterns").alias("pattern"))
        edges = materialize(every.groupBy("pattern", F.md5(F.col("word").cast("binary")).alias("name"), "seed").agg(F.first("word").alias("word")))
        trusted = materialize(edges.where("seed IS NOT NULL").select("name", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct())
        total = materialize(edges.select("pattern", "name").distinct().groupBy("pattern").agg(F.count("*").alias("instances")).where(f"instances >= {self.least}"))
        believed = None
        for turn in range(self.rounds):
            good = edges.select("pattern", "name").distinct().join(self._beside(trusted, 64), "name").groupBy("pattern", "kind").agg(F.sum("belief").alias("good")).where(F.col("good") >= self.least)
            scored = good.join(total, "pattern").withColumn("confidence", F.col("good") / F.col("instances") * (1 - F.pow(F.lit(0.5), F.col("good"))))
            believed = materialize(scored.where(F.col("confidence") >= self.trust).select("pattern", "kind", "confidence").join(F.broadcast(profiles), "kind"))  # profiles: a row per kind
            if turn < self.rounds - 1:
                new = self.extracted(edges.where("seed IS NULL"), believed).groupBy("name", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("belief"))
                trusted = materialize(trusted.unionByName(new.where(F.col("belief") >= self.trust)).groupBy("name", "kind").agg(F.max("belief").alias("belief")))
        return believed

    def extracted(self, rows: DataFrame, believed: DataFrame) -> DataFrame:
        """rows (pattern, word) that a believed pattern extracts, if they are made as its kind's seeds are."""
        digits, letters, at = (F.length(F.regexp_replace("word", p, "")) for p in ("[^0-9]", r"[^\p{L}]", "[^@]"))
        counted = digits.between(F.col("least_digits") - self.slack, F.col("most_digits") + self.slack) | (F.col("most_letters") > 0)  # digits don't define what is written with letters
        fits = counted & (letters > 0).cast("int").between(F.col("least_letters"), F.col("most_letters")) & (at > 0).cast("int").between(F.col("least_at"), F.col("most_at"))
        return rows.join(self._beside(believed, 128), "pattern").where(fits)

    def discovered(self, rows: DataFrame) -> DataFrame:
        """(k1, k2, more): per document (doc_id, text) the spans (kind, start, end, context) that patterns add.

        context: a pattern of the words around believes in the span; else its form alone does.
        Spans of a document don't overlap: the longer of those that begin together stays, and
        what begins inside a span that stays goes.
        """
        words = materialize(self.identifiers(with_base_spans(rows)))
        believed = self.patterns(words)
        free = words.where("seed IS NULL").select("k1", "k2", "start", "end", "word", F.explode("patterns").alias("pattern"))
        new = self.extracted(free, believed).groupBy("k1", "k2", "start", "end").agg(F.max(F.struct("confidence", "kind"))["kind"].alias("kind"), F.max(~F.startswith("pattern", F.lit("form: "))).alias("context"))
        found = new.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", (-F.col("end")).alias("back"), "kind", "context"))).alias("spans"))  # of one document
        kept = _scan("spans", _NO_SPANS, "IF(x.start >= s.at, -x.back, s.at)", "IF(x.start >= s.at, named_struct('kind', x.kind, 'start', x.start, 'end', -x.back, 'context', x.context), NULL)")
        return materialize(found.select("k1", "k2", F.expr(kept)["out"].alias("more")))

    def find(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, text and others) with __text, the base spans per kind, and more: the spans that patterns add.

        A null text counts as empty. Rows that repeat id and text get the same spans, rows that
        repeat an id with another text their own. The added spans are counted: few are
        broadcast, so that texts stay in place; many are joined by shuffle.
        """
        more = self.discovered(rows.select("doc_id", "text"))
        spans = more.agg(F.count("*") + F.sum(F.size("more"))).first()[0] or 0
        keyed = _named(with_base_spans(rows)).join(F.broadcast(more) if spans <= BROADCAST_IDS // 8 else more, ["k1", "k2"], "left").drop("k1", "k2")
        return keyed.withColumn("more", F.coalesce("more", F.array().cast(_NO_SPANS)))

    def transform(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_<kind>..., base_sha256, spans, n_found, n_context) per row; counts are of base spans.

        Spans are kind:start:end in code points, end exclusive, by kind as listed, then start,
        joined by commas; n_found counts those that patterns added, n_context those of them that
        the words around speak for, not the form alone. An empty table gives an empty
        result; columns of docs other than id and text don't matter.
        """
        got = self.find(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")))
        name = lambda k: lambda x: F.concat(F.lit(f"{k}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))
        every = lambda k: F.array_sort(F.concat(F.transform(f"__{k}", lambda x: F.struct(x["start"], x["end"])), F.transform(F.filter("more", lambda x: x["kind"] == k), lambda x: F.struct(x["start"], x["end"]))))
        return got.select(
            "doc_id",
            *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS],
            F.sha2(F.array_join(F.concat(*[F.transform(f"__{k}", name(k)) for k in KINDS]), ","), 256).alias("base_sha256"),
            F.array_join(F.concat(*[F.transform(every(k), name(k)) for k in KINDS]), ",").alias("spans"),
            F.size("more").cast("long").alias("n_found"),
            F.size(F.filter("more", lambda x: x["context"])).cast("long").alias("n_context"),
        )

    def mask(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """docs with every span of text_col replaced by its kind in angle brackets.

        Where spans of two kinds overlap, the one that begins first, or is longer, names the
        whole. Texts without personal data, and null texts, stay as they are; so do all columns,
        whatever their names. Repeated rows give repeated results, an empty table an empty one.
        """
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        got = self.find(docs.select(row, F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")))
        part = lambda kind: lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), (x["kind"] if kind is None else kind).alias("kind"))
        got = got.withColumn("spans", F.array_sort(F.concat(*[F.transform(f"__{k}", part(F.lit(k))) for k in KINDS], F.transform("more", part(None)))))
        # Overlapping spans become one; each piece is the text before a span and the span's kind. Texts are cut
        # by PIECE first, since a place in a text is found by counting from its start.
        cut = "IF(x.start >= s.at, named_struct('from', s.at, 'to', x.start, 'kind', x.kind), NULL)"
        got = got.withColumn("scan", F.expr(_scan("spans", "array<struct<from:int,to:int,kind:string>>", "greatest(s.at, -x.back)", cut)))
        got = got.withColumn("whole", F.expr("concat(scan.out, array(named_struct('from', scan.at, 'to', length(__text), 'kind', CAST(NULL AS string))))"))
        between = f"""array_join(transform(sequence(x.from DIV {PIECE}, (x.to - 1) DIV {PIECE}), j -> substring(get(pieces, j), CAST(greatest(x.from - j * {PIECE}, 0) + 1 AS int),
            CAST(least(x.to - j * {PIECE}, {PIECE}) - greatest(x.from - j * {PIECE}, 0) AS int))), '')"""
        joined = f"array_join(transform(whole, x -> concat(IF(x.from < x.to, {between}, ''), IF(x.kind IS NULL, '', concat('<', upper(x.kind), '>')))), '')"
        masked = F.expr(f"element_at(transform(array(regexp_extract_all(__text, '(?s).{{1,{PIECE}}}', 0)), pieces -> {joined}), 1)")  # named by a lambda, so that texts are cut once
        text = F.when(F.size("spans") > 0, masked).otherwise(F.col(f"row.`{text_col}`").cast("string")).alias(text_col)
        return got.select(*[text if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
