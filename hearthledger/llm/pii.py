"""Personal data (operator 3), native: DataFrame and SQL functions only.

Base rules find e-mail addresses, IPv4 addresses, payment cards and phone numbers in every whole text,
leftmost and non-overlapping per kind; matches that fail their check (address parts, Luhn, digit counts)
are dropped and not retried. Spans are code points, end exclusive.

The method finds what these rules do not: further candidates are key-like secrets, bank account numbers
(IBAN), national insurance numbers, personal names, street addresses, national phone numbers, obfuscated
addresses and card-like runs that fail a check. Six labelers vote on every candidate, base or not:
the strict pattern, the checksum or shape, a gazetteer (number ranges, domain endings, key prefixes, given
names, street types), context words in four languages, negative context, and the surrounding characters.
Expectation-maximisation over the counts of vote patterns (at most 3**6 for a kind) estimates each
labeler's reliability; the posteriors are the soft labels of a naive-Bayes span classifier, whose weights
decide. Base spans stay whatever it says; a candidate that overlaps one, or a candidate that begins
earlier, is none.

Regular expressions repeat no groups without a bound and start only at the edge of a run, so that texts of
any length neither overflow the stack nor cost quadratic time; spans are collected in blocks of SPAN_BLOCK
pieces.

Defined cases: a null text is empty (in ``redact`` it stays null); an empty text has no spans
(``base_sha256`` is that of the empty string); rows are judged one by one, repeated or not; other columns,
whatever their names, pass through; without any candidate the classifier has only its prior and accepts nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, scratch, table

#: The base kinds in their order, then those that only the method finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "id", "secret", "name", "street")
LABELERS = 6
EM_STEPS = 20
#: Rates of abstention, no and yes that a labeler starts with, for private spans and for others; also one pseudo-vote.
FIRST_HIT, FIRST_MISS = (0.3, 0.1, 0.6), (0.4, 0.5, 0.1)
SPAN_BLOCK = 256
#: Context words: fixed values of the labelers, English, French, German, Spanish.
CONTEXT = {
    "email": "mail|contact|courriel|kontakt|correo|write to|reply",
    "ip": "address|host|server|client|login|adresse|rechner|servidor",
    "card": "card|visa|mastercard|amex|payment|carte|karte|tarjeta|account|konto|compte|cuenta",
    "phone": "phone|call|tel|mobile|fax|appel|anruf|handy|llam",
    "secret": "token|secret|key|passw|pwd|credential|auth|bearer|clave|mot de passe|kennwort|schl.ssel",
    "iban": "iban|account|bank|konto|compte|banque|cuenta|banco",
    "id": "ssn|social|security|insurance|tax|steuer|sozial|seguridad|s.curit|dni",
    "name": "name|signed|dear|hello|contact|regards|sincerely|hei.e|appelle|llamo|nom|gr..e|saludos",
    "street": "address|live|living|home|deliver|ship|adresse|wohn|habite|direcci|vive|visit",
}
NEGATIVE = "version|release|build|isbn|issn|order|invoice|page|serial|sha|sha1|sha256|md5|hash|commit|section|checksum|digest|revision|uuid|saint|san|santa"
#: Given names common in the four languages: fixed values of the gazetteer.
GIVEN = (
    "Adam Alan Alice Ana Andrea Anna Anne Antonio Barbara Carlos Carmen Charles Charlotte Christian Claire Clara Daniel David Diego Elena "
    "Elisabeth Elizabeth Emily Emma Eric Eva Frank Georg George Hans Heinrich Helen Henri Henry Ines Isabel Jack Jacques James Jan Jane Javier "
    "Jean Johann John Jonas Jorge Jose Joseph Juan Julia Julie Karl Katharina Klaus Laura Louis Lucas Lucia Luis Luise Manuel Maria Marie Mark "
    "Martin Mary Michael Miguel Nicolas Nina Oliver Oscar Pablo Patrick Paul Pedro Peter Philippe Pierre Rafael Richard Robert Rosa Sara Sarah "
    "Simon Sofia Sophie Stefan Susan Teresa Thomas Ursula Victor Walter William"
)
_SPACE = r"\\x20\\x09-\\x0D"
_LOCAL = r"A-Za-z0-9._%+\u0005-"
_KEY = "A-Za-z0-9_+/-"
_TITLE = "(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)"
_WORD = r"\p{Lu}\p{Ll}{1,30}"
_NAMES = f"(?:{'|'.join(GIVEN.split())})"


def _pieces(text: str, pattern: str) -> str:
    """Text cut at matches: pieces at even positions (from 1) are the matches."""
    return rf"split(regexp_replace({text}, r'{pattern}', '\u0001$0\u0002'), '[\u0001\u0002]')"


_SPAN = "struct<start:int,end:int,kind:string,base:boolean,match:string,before:string,left:string,right:string>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _blocks(array: str) -> str:
    return f"sequence(0, (size({array}) - 1) div {SPAN_BLOCK})"


def _scan(x: str, keep: str, base: str, kind: str) -> str:
    """Spans of the pieces ``x`` that satisfy ``keep`` (over ``@m``, the match), with what stands around them."""
    m = f"{x}[i - 1]"
    near = f"right(concat(CASE WHEN i > 2 THEN right({x}[i - 3], 40) ELSE '' END, {x}[i - 2]), 40)"
    span = f"""named_struct('start', s.pos, 'end', s.pos + length({m}), 'kind', '{kind}', 'base', {base.replace("@m", m)}, 'match', {m},
      'before', lower({near}), 'left', right({near}, 1), 'right', left(concat({x}[i], CASE WHEN i + 1 < size({x}) THEN {x}[i + 1] ELSE '' END), 1))"""
    lengths = f"transform({_blocks(x)}, k -> aggregate(slice({x}, k * {SPAN_BLOCK} + 1, {SPAN_BLOCK}), 0, (a, p) -> a + length(p)))"
    starts = f"aggregate({lengths}, named_struct('pos', 0, 'out', cast(array() as array<int>)), (s, l) -> named_struct('pos', s.pos + l, 'out', array_append(s.out, s.pos)), s -> s.out)"
    one = f"""aggregate(sequence(k * {SPAN_BLOCK} + 1, least((k + 1) * {SPAN_BLOCK}, size({x}))), named_struct('pos', o[k], 'out', {_NONE}),
      (s, i) -> named_struct('pos', s.pos + length({m}), 'out', CASE WHEN i % 2 = 0 AND {keep.replace("@m", m)} THEN array_append(s.out, {span}) ELSE s.out END), s -> s.out)"""
    return f"transform(array({starts}), o -> flatten(transform({_blocks(x)}, k -> {one})))[0]"


_DIGITS = "regexp_replace(@m, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, j) -> a + CASE WHEN j % 2 = 1 THEN cast(substring(reverse({_DIGITS}), j, 1) as int)
  ELSE 2 * cast(substring(reverse({_DIGITS}), j, 1) as int) - CASE WHEN substring(reverse({_DIGITS}), j, 1) > '4' THEN 9 ELSE 0 END END) % 10 = 0"""
_CARD = f"(length(@m) >= 14 AND length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN})"
_IP = "forall(split(@m, '[.]'), p -> coalesce(try_cast(p as decimal(38, 0)), 256) <= 255)"
_PHONE = f"(length({_DIGITS}) BETWEEN 10 AND 15)"
_LIKE_CARD = f"(length(@m) >= 13 AND length({_DIGITS}) BETWEEN 13 AND 19)"
#: The remainder by 97 of an IBAN with its head moved to the end and letters as numbers from 10.
_IBAN = """aggregate(split(concat(substring(replace(@m, ' ', ''), 5), left(@m, 4)), ''), 0,
  (a, d) -> CASE WHEN d = '' THEN a WHEN d BETWEEN '0' AND '9' THEN (a * 10 + cast(d as int)) % 97 ELSE (a * 100 + ascii(d) - 55) % 97 END) = 1"""

#: kind, text to cut, pattern, guard, what to keep, whether it is a base span.
_FINDERS = [
    ("email", r"regexp_replace(_t, r'(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])', '\u0005')", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\u0005[A-Za-z0-9\u0005-]++", "instr(_t, '@') > 0", "true", "true"),
    ("ip", "_t", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"_t RLIKE r'[0-9]\.[0-9]'", _IP, "true"),
    ("card", r"regexp_replace(_t, r'(?<=[0-9])[ -](?=[0-9])', '\u0004')", "[0-9][0-9\\u0004]*[0-9]", "_t RLIKE '[0-9][0-9]'", _LIKE_CARD, _CARD),
    ("phone", "_t", r"\+[0-9][ ().0-9-]+[0-9]", r"_t RLIKE r'\+[0-9]'", f"length({_DIGITS}) BETWEEN 7 AND 15", _PHONE),
    ("phone", "_t", r"(?<![0-9A-Za-z+(.-])(?<![0-9][ ])[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[ .-][0-9])", "_t RLIKE '[0-9]{4}'", "true", "false"),
    ("email", "_t", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63} ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z]{2,24}", r"_t RLIKE r'(?i)[\[(]at[\])]'", "true", "false"),
    ("secret", "_t", rf"(?<![{_KEY}])[{_KEY}]{{16,}}+={{0,2}}", f"_t RLIKE '[{_KEY}]{{16}}'", "@m RLIKE '[0-9]' AND @m RLIKE '[A-Za-z]'", "false"),
    ("iban", "_t", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "_t RLIKE '[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}'", "true", "false"),
    ("id", "_t", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])", "_t RLIKE '[0-9]-[0-9]{2}-[0-9]'", "true", "false"),
    ("name", "_t", rf"(?<!\p{{L}})(?:{_TITLE}\.? {_WORD}(?: {_WORD})?|{_NAMES} (?:[A-Z]\. )?{_WORD})(?!\p{{L}})", rf"_t RLIKE r'(?<!\p{{L}})(?:{_TITLE}\.?|{_NAMES}) \p{{Lu}}'", "true", "false"),
    (
        "street", "_t",
        rf"(?<![\p{{L}}0-9])(?:[0-9]{{1,5}},? (?:{_WORD} ){{1,3}}(?:Street|Road|Avenue|Lane|Drive|Boulevard|Court)|[0-9]{{1,4}},? (?:rue|avenue|boulevard|place|chemin) (?:d[eu] (?:la )?)?{_WORD}|{_WORD}(?:straße|strasse|weg|platz|allee|gasse) [0-9]{{1,4}}|(?:Calle|Avenida|Plaza|Paseo) (?:de (?:la )?)?{_WORD},? [0-9]{{1,4}})(?![\p{{L}}0-9])",
        r"_t RLIKE '[0-9]' AND _t RLIKE r'(?i)(?:street|road|avenue|lane|drive|boulevard|court|rue|place|chemin|stra(?:ß|ss)e|weg|platz|allee|gasse|calle|avenida|plaza|paseo)'", "true", "false",
    ),
]


def _candidates() -> Column:
    """Array of candidate spans of column ``_t`` (control characters 1 to 6 already replaced)."""
    every = []
    for kind, text, pattern, guard, keep, base in _FINDERS:
        # a one-element transform binds the pieces once
        every.append(f"CASE WHEN {guard} THEN transform(array({_pieces(text, pattern)}), _x -> {_scan('_x', keep, base, kind)})[0] ELSE {_NONE} END")
    return F.expr(f"concat({', '.join(every)})")


def _order(kind: str) -> str:
    return "CASE " + " ".join(f"WHEN {kind} = '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"


def _free(spans: str, first: str, counts: str) -> str:
    """Of an array of spans, sorted so that ``first`` comes first: base ones, and those that no earlier one (where ``counts``) reaches into."""
    highest = f"greatest(s, CASE WHEN {counts} THEN c.end ELSE 0 END)"
    sort = f"transform(array_sort(transform({spans}, c -> named_struct('k', {first}, 'c', c)), (x, y) -> CASE WHEN x.k < y.k THEN -1 WHEN x.k > y.k THEN 1 ELSE 0 END), x -> x.c)"
    tops = f"transform({_blocks('a')}, k -> aggregate(slice(a, k * {SPAN_BLOCK} + 1, {SPAN_BLOCK}), 0, (s, c) -> {highest}))"
    before = f"aggregate({tops}, named_struct('m', 0, 'out', cast(array() as array<int>)), (s, t) -> named_struct('m', greatest(s.m, t), 'out', array_append(s.out, s.m)), s -> s.out)"
    one = f"""aggregate(slice(a, k * {SPAN_BLOCK} + 1, {SPAN_BLOCK}), named_struct('m', o[k], 'out', {_NONE}),
      (s, c) -> named_struct('m', {highest.replace('(s,', '(s.m,')}, 'out', CASE WHEN c.base OR c.start >= s.m THEN array_append(s.out, c) ELSE s.out END), s -> s.out)"""
    return f"transform(array({sort}), a -> transform(array({before}), o -> flatten(transform({_blocks('a')}, k -> {one})))[0])[0]"


def _by_kind(cases: dict[str, str], other: str) -> str:
    return "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE {other} END"


def _described() -> str:
    """Each candidate with its six votes (1 private, 0 not, -1 abstains) and its classifier features."""
    digits = "regexp_replace(c.match, '[^0-9]', '')"
    bare = "NOT c.left RLIKE '[A-Za-z0-9]' AND NOT c.right RLIKE '[A-Za-z0-9]'"
    vote = lambda yes, no="false": f"CASE WHEN {yes} THEN 1 WHEN {no} THEN 0 ELSE -1 END"
    context = _by_kind({k: f"c.before RLIKE '{w}'" for k, w in CONTEXT.items()}, "false")
    negative = f"c.before RLIKE '(?:^|[^a-z])({NEGATIVE})[^a-z0-9]*$'"
    # what every candidate of a kind fulfils is no vote: labelers abstain where they have nothing to say
    strict = {
        "secret": vote("c.match RLIKE '^(AKIA|ASIA|ghp_|gho_|glpat-|sk_|pk_|sk-|xox|AIza|eyJ)'", "NOT c.match RLIKE '[0-9].*[0-9].*[0-9]'"),
        "iban": "-1", "id": "-1", "name": vote(rf"c.match RLIKE r'^{_TITLE}\.? '"), "street": "-1", "ip": vote("c.base", "true"), "card": vote("c.base", "true"),
    }
    luhn, iban = _LUHN.replace("@m", "c.match"), _IBAN.replace("@m", "c.match")
    check = {
        "card": vote(luhn, "true"), "ip": vote("c.base", "true"), "phone": vote(f"length({digits}) BETWEEN 10 AND 15", "true"),
        "secret": vote("false", "size(array_distinct(split(c.match, ''))) < 9 OR c.match LIKE '%/%/%'"), "iban": vote(iban, "true"),
        "id": vote("NOT c.match RLIKE '^(000|666|9)' AND NOT c.match RLIKE '-00-|-0000$'", "true"),
    }
    gazetteer = {
        "card": vote("c.match RLIKE '^[3-6]'", "true"), "email": vote("c.match RLIKE '(?i)(com|org|net|edu|gov|info|de|fr|es|uk|eu)$'"),
        "phone": vote("c.match RLIKE '^[+][1-9]'"), "ip": vote("NOT c.match RLIKE r'^(0|10|127|192[.]168)[.]'", "true"),
        "iban": vote("left(c.match, 2) IN ('AT', 'BE', 'CH', 'DE', 'DK', 'ES', 'FI', 'FR', 'GB', 'IE', 'IT', 'LU', 'NL', 'NO', 'PL', 'PT', 'SE')", "true"),
        "name": vote(rf"c.match RLIKE r'(?:^| ){_NAMES} '"), "street": "1",
    }
    around = {"secret": vote("""c.left RLIKE '["=:\\x27]'""", "c.left RLIKE '[./]' OR c.right RLIKE '[./][A-Za-z]'")}
    votes = [
        _by_kind(strict, vote("c.base")),
        _by_kind(check, "-1"),
        _by_kind(gazetteer, "-1"),
        vote(context),
        vote("false", negative),
        _by_kind(around, vote(bare, "true")),
    ]
    side = lambda c: f"CASE WHEN {c} = '' OR {c} RLIKE '[{_SPACE}]' THEN 'space' WHEN {c} RLIKE '[0-9]' THEN 'digit' WHEN {c} RLIKE '[A-Za-z]' THEN 'letter' ELSE 'other' END"
    features = [
        "concat('kind=', c.kind)",
        f"concat(c.kind, ' digits=', least(length({digits}), 20))",
        f"concat(c.kind, ' left=', {side('c.left')})",
        f"concat(c.kind, ' right=', {side('c.right')})",
        *(f"concat(c.kind, ' {n}=', v[{i}])" for i, n in enumerate(("strict", "check", "known", "word", "not", "around"))),
    ]
    return f"""transform(_c, c -> transform(array(array({', '.join(votes)})), v -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind, 'base', c.base,
      'votes', v, 'features', array({', '.join(features)})))[0])"""


def spans_of(docs: DataFrame, text: str = "text", **kept: Column) -> DataFrame:
    """The columns ``kept`` and ``spans``: candidates sorted by start and kind, extra ones only where no base span lies."""
    t = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "\u0001\u0002\u0003\u0004\u0005\u0006", "\u0007" * 6)
    # a struct keeps the names of other columns apart from the working ones
    out = docs.select(F.struct(*(c.alias(n) for n, c in kept.items())).alias("_row"), t.alias("_t")).withColumn("_c", _candidates())
    off_base = _free("_c", "struct(CASE WHEN c.base THEN c.start ELSE c.end END, c.base)", "c.base")
    apart = _free("_c", f"struct(c.start, {_order('c.kind')}, c.end)", "NOT c.base")
    sort = f"array_sort(_c, (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE {_order('a.kind')} - {_order('b.kind')} END)"
    for step in (f"CASE WHEN exists(_c, c -> NOT c.base) THEN {off_base} ELSE _c END", f"CASE WHEN exists(_c, c -> NOT c.base) THEN {apart} ELSE _c END", sort):
        out = out.withColumn("_c", F.expr(f"CASE WHEN size(_c) > 0 THEN {step} ELSE _c END"))
    return out.withColumn("spans", F.expr(_described())).select("_row.*", "spans")


def _em(patterns: DataFrame) -> DataFrame:
    """Dawid-Skene expectation-maximisation for each kind over its vote patterns: kind, votes, post."""
    doubles = lambda xs: "array(" + ", ".join(f"{x}D" for x in xs) + ")"
    start = ", ".join([f"named_struct('hit', {doubles(FIRST_HIT)}, 'miss', {doubles(FIRST_MISS)})"] * LABELERS)
    like = lambda y: " * ".join(f"p.l[{j}].{y}[q.votes[{j}] + 1]" for j in range(LABELERS))
    post = f"(p.prior * {like('hit')}) / (p.prior * {like('hit')} + (1 - p.prior) * {like('miss')})"
    soft = f"transform(q_, q -> named_struct('votes', q.votes, 'n', q.n, 'w', {post}))"
    total = lambda e: f"aggregate(e, 0D, (a, q) -> a + {e})"
    # an abstention is a vote of its own: a labeler that only ever says yes, or only no, tells by its silence
    rate = lambda j, w, v, first: f"({total(f'CASE WHEN q.votes[{j}] = {v} THEN q.n * {w} ELSE 0D END')} + {first[v + 1]}D) / ({total(f'q.n * {w}')} + 1D)"
    rates = lambda j, w, first: f"array({', '.join(rate(j, w, v, first) for v in (-1, 0, 1))})"
    step = f"""transform(array({soft}), e -> named_struct('prior', ({total('q.n * q.w')} + 1D) / ({total('q.n')} + 2D),
      'l', array({', '.join(f"named_struct('hit', {rates(j, 'q.w', FIRST_HIT)}, 'miss', {rates(j, '(1 - q.w)', FIRST_MISS)})" for j in range(LABELERS))})))[0]"""
    fit = f"aggregate(sequence(1, {EM_STEPS}), named_struct('prior', 0.5D, 'l', array({start})), (p, i) -> {step})"
    by_kind = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("q_"))
    return by_kind.withColumn("p", F.expr(fit)).select("kind", F.expr(f"explode({soft})").alias("e")).select("kind", "e.votes", F.col("e.w").alias("post"))


def fit(spans: DataFrame, tag: str = "pii") -> dict[str, float]:
    """Log-odds of the classifier's features from all candidate spans (kind, votes, features); a bounded table."""
    counts = spans.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
    post = durable(_em(counts), f"{tag}-posteriors")
    soft = spans.join(F.broadcast(post), ["kind", "votes"])
    # the first feature, the kind, carries the kind's own prior; all others are conditional on the kind
    sums = soft.select("kind", F.explode("features").alias("f"), "post").groupBy("kind", "f").agg(F.sum("post").alias("yes"), F.sum(1 - F.col("post")).alias("no"))
    whole = {r.kind: (r.yes, r.no) for r in soft.groupBy("kind").agg(F.sum("post").alias("yes"), F.sum(1 - F.col("post")).alias("no")).collect()}
    weights = {}
    for r in sums.collect():
        yes, no = whole[r.kind]
        prior = math.log((yes + 1) / (no + 1))
        weights[r.f] = round(prior if r.f == f"kind={r.kind}" else math.log((r.yes + 1) / (r.no + 1)) - prior, 9)
    return weights | {"": -1e-9}


def accepted(weights: dict[str, float], spans: str = "spans") -> Column:
    """The candidates of the array ``spans`` that stay: all base ones, others by the classifier."""
    known = F.create_map(*(F.lit(x) for kv in sorted(weights.items()) for x in kv))
    score = lambda c: F.aggregate(c.features, F.lit(weights[""]), lambda a, f: a + F.coalesce(F.try_element_at(known, f), F.lit(0.0)))
    return F.filter(spans, lambda c: c.base | (score(c) >= 0.0))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c.kind, c.start.cast("string"), c.end.cast("string"))), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = durable(spans_of(docs, doc_id=F.col("doc_id")), "pii-spans")
    weights = fit(found.select(F.inline("spans")).select("kind", "votes", "features"))
    base = F.filter("spans", lambda c: c.base)
    counts = [F.expr(f"cast(size(filter(spans, c -> c.base AND c.kind = '{k}')) as long) AS n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(accepted(weights)).alias("spans"))


def redact(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``found`` (row, a struct with ``text``, and spans): the columns of row, accepted spans of ``text`` replaced by ``<KIND>``; of overlapping ones the first."""
    names = found.schema["row"].dataType.fieldNames()
    ends = "aggregate(_s, named_struct('end', 0, 'out', cast(array() as array<int>)), (s, c) -> named_struct('end', greatest(s.end, c.end), 'out', array_append(s.out, s.end)), s -> s.out)"
    # text before each span and its mark; a span inside what is already covered adds nothing
    parts = "zip_with(_s, _e, (c, e) -> CASE WHEN c.start < e THEN '' ELSE concat(substring(row.text, e + 1, c.start - e), '<', upper(c.kind), '>') END)"
    out = found.withColumn("_s", accepted(weights)).withColumn("_e", F.expr(ends))
    masked = F.expr(f"CASE WHEN size(_s) > 0 THEN concat(array_join({parts}, ''), substring(row.text, array_max(transform(_s, c -> c.end)) + 1)) ELSE row.text END")
    return out.withColumn("_m", masked).select(*(F.col("_m").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced in the text; n_chars, where there, follows."""
    found = durable(spans_of(docs, row=F.struct(*(F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in docs.columns))), "pii-stage")
    with scratch(spark):
        weights = fit(found.select(F.inline("spans")).select("kind", "votes", "features"), "pii-stage")
    out = redact(found, weights)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
