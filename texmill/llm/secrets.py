"""Secret scanning with DataFrame functions alone: candidates by pattern, false positives removed by a random forest.

Candidates are key blocks, web tokens, known key formats, values assigned to words such as password or token, and other
long runs of key characters with a digit in them. Each candidate becomes numbers: its length, character make-up and
transitions, how much of it is dictionary words, whether it looks like a path, and which words and signs are next to
it. A random forest, trained on labelled findings, scores them. The findings are made by SQL from a fixed seed (kinds
of real keys and of look-alikes, ``TRAINING_ROWS`` in all, in several surroundings); the forest is fitted on the
driver and goes into the plan as a literal, which is walked with higher-order functions. Scanning is row by row: no
shuffle, no broadcast, no Python. Its cost grows with the text and the number of candidates, not with their product.

Defined results: null and empty texts have no findings; equal candidates in one text are separate findings; texts of
any length are scanned whole; offsets are in code points; repeated rows, and rows of null or repeated ids, have their
own findings each; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texmill.functions.folds import before as _before
from texmill.functions.folds import let as _let
from texmill.llm._common import read

DEPTH, TREES, TRAINING_ROWS = 7, 15, 5000

# Key formats, words near secrets, words near look-alikes, words that make up ordinary names, and common pairs of letters.
KEYS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[0-9A-Za-z-]{10}|sk-[A-Za-z0-9_-]{20}|[sr]k_(?:live|test)_[0-9A-Za-z]{16}|AIza[0-9A-Za-z_-]{35}|glpat-[0-9A-Za-z_-]{20}|npm_[A-Za-z0-9]{36}|SG\.[A-Za-z0-9_-]{16}"
KNOWN = KEYS + r"|eyJ[A-Za-z0-9_-]{8}|-----BEGIN"
SECRET_WORDS = r"token|secret|passw(?:or)?d|pwd|passphrase|api[_ -]?key|access[_ -]?key|private[_ -]?key|secret[_ -]?key|signing[_ -]?key|encryption[_ -]?key|master[_ -]?key|auth|authorization|bearer|credentials?|client[_ -]?key"
LOOKALIKE_WORDS = r"sha-?\d*|commit|hash|md5|checksum|digest|revision|uuid|guid|card|iban|isbn|phone|order|invoice|version|build|etag|image|img|src|href|path|file|url|page|id|integrity|class|tree|parent"
DICTIONARY = (
    "access account action active address admin after alert app archive article asset author back banner body border branch browser build button cache card "
    "center change class client code color comment common company component config contact content control cover create current data date debug default "
    "demo der design device dist email end error event example export field file filter font footer form from get head home host icon image index info "
    "input insert install key label light line link list log main make manager map master media menu message method mobile model module name network new "
    "next node none number object office page panel password path placeholder plan plugin point post preview price private product profile project public "
    "query read record redacted report request response result review road root sample schema school script search second secret section server service "
    "session set shop side site small social source start state static status step store street string style summary support system table tag task team "
    "template test text the thing title token tool top total travel type update upload user value version video view wall water web white widget window "
    "word work world year your "
).split()
COMMON_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()

#: What leads to an assigned value; it is taken off the candidate again.
NAMED = rf"(?i:{SECRET_WORDS})(?:[_-][A-Za-z0-9]{{1,12}}){{0,2}}"
LEAD = rf"{NAMED}[\"']?\s{{0,2}}[:=]\s{{0,2}}(?i:(?:bearer|basic|token) )?[\"']?"
ASSIGNED = r"(?i:passwd|password|pwd|secret|passphrase)[\"']?\s{0,2}[:=]\s{0,2}[\"']?"

_PEM = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+)?"

#: Values in quotes end at the quote; others, but for passwords, with the key characters. Key blocks and web tokens are left to their own patterns.
CANDIDATE = (
    rf"{_PEM}[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{{0,24}}PRIVATE KEY-----)?"
    rf"|(?<![A-Za-z0-9_-]){_TOKEN}"
    rf"|{ASSIGNED}(?!{_PEM})[^\s\"'<>]{{8,}}+"
    rf"|{NAMED}[\"']?\s{{0,2}}[:=]\s{{0,2}}(?i:(?:bearer|basic|token) )?(?:[\"'](?!{_PEM})[^\s\"'<>]{{8,}}+|(?!{_PEM}|{_TOKEN})[A-Za-z0-9+/_=-]{{8,}}+)"
    rf"|(?<![A-Za-z0-9])(?:{KEYS})[A-Za-z0-9+/_=-]*+"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
)


def _may_hold_one(text: Column) -> Column:
    """Whether there is a candidate: most texts end here."""
    return text.rlike("(?d)" + CANDIDATE)


def _candidates(text: Column) -> Column:
    """array<struct<gap, lead, value, next>>: every candidate, the text before it, and the text after it, both up to the next one."""
    pattern = F.lit("(?d)" + CANDIDATE)

    def paired(around: Column) -> Column:
        values = F.regexp_extract_all(text, pattern, F.lit(0))
        pairs = F.zip_with(values, F.slice(around, F.lit(1), F.size(around) - 1), lambda v, g: F.struct(v.alias("value"), F.regexp_extract(v, f"^{LEAD}", 0).alias("lead"), g.alias("gap")))
        return F.zip_with(pairs, F.slice(around, F.lit(2), F.size(around)), lambda p, a: F.struct(p["gap"].alias("gap"), p["lead"].alias("lead"), F.substr(p["value"], F.length(p["lead"]) + 1).alias("value"), a.alias("next")))

    return _let(F.split(text, "(?d)" + CANDIDATE, -1), paired)


def _context(c: Column) -> tuple[Column, Column, Column]:
    """Value, before and after, as features() takes them."""
    return c["value"], F.right(F.concat(c["gap"], c["lead"]), F.lit(40)), F.left(c["next"], F.lit(16))


def findings(text: Column | str) -> Column:
    """array<struct<value, before, after, first>> of a text's candidates; empty where there are none."""
    text = F.col(text) if isinstance(text, str) else text
    empty = F.expr("cast(array() as array<struct<value:string,before:string,after:string,first:bigint>>)")

    def placed(found: Column) -> Column:
        sizes = F.transform(found, lambda c: (F.length(c["gap"]) + F.length(c["lead"]) + F.length(c["value"])).cast("long"))

        def one(c: Column, at: Column) -> Column:
            value, before, after = _context(c)
            return F.struct(value.alias("value"), before.alias("before"), after.alias("after"), (at + F.length(c["gap"]) + F.length(c["lead"])).alias("first"))

        return F.zip_with(found, _before(sizes), one)

    return F.when(_may_hold_one(text), _let(_candidates(text), placed)).otherwise(empty)


def _share(x: Column, kept: str, size: Column) -> Column:
    return F.length(F.regexp_replace(x, f"[^{kept}]", "")) / size


def features(value: Column, before: Column, after: Column) -> Column:
    """array<double> that the forest sees."""
    size, low = F.greatest(F.length(value), F.lit(1)).cast("double"), F.lower(value)
    near = F.lower(before)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[A-Z]", "U"), "[a-z]", "l"), "[0-9]", "d"), "[^Uld]", "s")
    turns = F.length(F.regexp_replace(classes, r"(.)\1++", "$1"))
    letters = F.regexp_replace(low, "[^a-z]", "")
    vowels = F.regexp_replace(F.regexp_replace(letters, "[aeiou]", "#"), "[a-z]", "-")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.array(
        F.least(size, F.lit(128.0)),
        F.size(F.array_distinct(F.split(F.left(value, F.lit(64)), ""))) / F.least(size, F.lit(64.0)),
        _share(value, "0-9", size),
        _share(value, "A-Z", size),
        _share(value, "a-z", size),
        _share(low, "0-9a-f", size),
        turns / size,
        F.length(F.regexp_replace(vowels, r"(.)\1++", "$1")) / size,
        1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / size,
        F.regexp_count(low, F.lit(f"(?=(?:{'|'.join(COMMON_PAIRS)}))")) / size,
        F.length(F.regexp_replace(value, "[^/]", "")).cast("double"),
        F.length(F.regexp_replace(value, "[^-]", "")).cast("double"),
        flag(near.rlike(rf"(?:{NAMED}|[a-z0-9]{{2,20}}[_-]key)[^a-z\n]{{0,12}}(?:(?:bearer|basic|token) [^a-z\n]{{0,4}})?$")),
        flag(near.rlike(r"[:=]\s{0,3}[\"'`]?$")),
        flag(near.rlike(r"[\"'`]$") & after.rlike("^[\"'`]")),
        flag(near.rlike(rf"(?:^|[^a-z])(?:{LOOKALIKE_WORDS})[^a-z\n]{{0,6}}$")),
        flag(value.rlike(f"^(?:{KNOWN})")),
        flag(near.rlike(r"[/\\.:]$")),
    ).cast("array<double>")


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """value, before, after, label: keys and look-alikes in their surroundings, made by SQL alone."""
    key = lambda n, salt: f"substring(translate(base64(unhex(concat(sha2(concat('{salt}', id), 512), sha2(concat('{salt}x', id), 512)))), '+/=', 'qZ7'), 1, {n})"
    hexa = lambda n, salt: f"substring(sha2(concat('{salt}', id), 512), 1, {n})"
    digits = lambda n, salt: f"substring(translate(sha2(concat('{salt}', id), 512), 'abcdef', '123456'), 1, {n})"
    word = lambda salt: f"element_at(array('section','report','der','entre','able','figure','thing','onder','mente','over','ation','result'), cast(pmod(hash('{salt}', id), 12) + 1 as int))"
    pick = lambda salt, *of: f"element_at(array({', '.join(repr(x) for x in of)}), cast(pmod(hash('{salt}', id), {len(of)}) + 1 as int))"
    sign = pick("s", ' = "', '="', ': "', "=", ": ", " = ", '": "')
    named = pick("n", "token", "secret", "api_key", "password", "access_key", "auth_token", "client_secret", "passwd", "SECRET_KEY", "signing_key", "DB_PASSWORD", "bearer")
    plain = pick("p", "commit ", "sha256: ", 'md5 = "', 'checksum = "', "hash: ", "revision ", 'etag = "', "digest: ", "tree ", 'integrity="sha384-')
    sizes = pick("z", 20, 24, 32, 40, 48, 64)
    kinds = [  # value, before, label
        (hexa(sizes, "a"), f"concat({named}, {sign})", 1),
        (key(sizes, "b"), f"concat({named}, {sign})", 1),
        (hexa(sizes, "c"), f"concat({named}, ' = \"')", 1),
        (f"translate({key(sizes, 'ce')}, '0123456789', 'ghjkmnpqrs')", f"concat({named}, {sign})", 1),
        (f"lower(translate({key('24', 'cf')}, '0123456789', 'ghjkmnpqrs'))", f"concat({named}, {sign})", 1),
        (key(sizes, "cg"), f"concat({pick('ch', 'MAILER_KEY', 'maps_key', 'x-service-key', 'DEPLOY_KEY')}, {sign})", 1),
        (hexa(sizes, "ca"), pick("cb", "Authorization: Bearer ", "Proxy-Authorization: Basic ", "auth: Bearer ", "with bearer token "), 1),
        (key(sizes, "cc"), pick("cd", "Authorization: Bearer ", "Proxy-Authorization: Basic ", "auth: Bearer ", "with bearer token "), 1),
        (f"concat('AKIA', upper({key(16, 'd')}))", f"concat({word('da')}, ' ')", 1),
        (f"concat('ghp_', {key(36, 'e')})", f"concat({word('ea')}, ' ')", 1),
        (f"concat('sk-', {key(40, 'f')})", f"concat({word('fa')}, ' ')", 1),
        (f"concat('eyJ', {key(30, 'g')}, '.', {key(60, 'h')}, '.', {key(43, 'i')})", "'Authorization: Bearer '", 1),
        (f"concat('xoxb-', {digits(12, 'j')}, '-', {key(24, 'k')})", f"concat({word('ja')}, ' ')", 1),
        (key(12, "l"), f"concat('password', {pick('l', ' = "', ': ', '=')})", 1),
        (f"concat({word('la')}, {pick('lb', '!', '_', '-', '#')}, {digits(4, 'lc')}, {key(3, 'ld')})", f"concat({pick('le', 'password', 'passwd', 'pwd')}, {sign})", 1),
        (f"concat('AIza', {key(35, 'm')})", "'key='", 1),
        (hexa(sizes, "n"), plain, 0),
        (key("64", "na"), plain, 0),
        (hexa(sizes, "o"), f"concat({word('oa')}, ' ')", 0),
        (f"concat_ws('-', {hexa(8, 'p')}, {hexa(4, 'q')}, {hexa(4, 'r')}, {hexa(4, 's')}, {hexa(12, 't')})", pick("u", 'id = "', "uuid: ", " ", "guid="), 0),
        (digits(16, "u"), f"concat({word('ua')}, {pick('v', ' ', ', ', ' card ')})", 0),
        (digits(sizes, "v"), pick("w", 'id = "', "order: ", "invoice "), 0),
        (f"concat_ws('/', {word('w')}, {word('wa')}, concat({word('wb')}, {digits(3, 'wc')}))", pick("x", 'path = "', "/", " "), 0),
        (f"concat({word('x')}, {word('xa')}, {word('xb')}, {digits(2, 'xc')})", f"concat({word('xd')}, ' ')", 0),
        (f"concat({word('xe')}, initcap({word('xf')}), {digits(1, 'xg')}, initcap({word('xh')}), initcap({word('xi')}))", f"concat({word('xj')}, {pick('xk', ' ', '.', '(')})", 0),
        (f"concat_ws('_', {word('xl')}, {word('xm')}, {digits(2, 'xn')}, {word('xo')})", f"concat({word('xp')}, {pick('xq', ' ', '.', ' = ')})", 0),
        (f"concat('your_', {named}, '_', {digits(2, 'y')}, '_example')", f"concat({named}, {sign})", 0),
        (f"concat({word('yf')}, {pick('yg', '_', '-', '')}, {word('yh')}, {pick('yi', '', '_here', '-name')})", f"concat({pick('yj', 'token', 'auth', 'secret', 'api_key', 'credentials')}, {pick('yk', ': ', '=', ' = ')})", 0),
        (f"concat_ws('-', {word('ya')}, {word('yb')}, {digits(4, 'yc')}, {digits(2, 'yd')})", f"concat({word('ye')}, ' ')", 0),
        (key("96", "z"), pick("y", "src=\"data:image/png;base64,", "img ", "image: "), 0),
    ]
    rows_of = [f"WHEN {k} THEN named_struct('value', {v}, 'before', {b}, 'label', {y})" for k, (v, b, y) in enumerate(kinds)]
    made = spark.range(0, rows, 1, 1).selectExpr("id", f"CASE id % {len(kinds)} {' '.join(rows_of)} END AS f")
    upper = "pmod(hash('case', id), 8) = 0 AND f.value RLIKE '^[0-9a-f]+$'"
    cased = made.selectExpr("id", f"CASE WHEN {upper} THEN upper(f.value) ELSE f.value END AS value", f"CASE WHEN {upper} THEN upper(f.before) ELSE f.before END AS before", "f.label AS label")
    noise = "element_at(array('', ', ', '.', '###', '!!', ' '), cast(pmod(hash('e', id), 6) + 1 as int))"
    return cased.selectExpr("value", "concat('le onder ', before) AS before", f"concat(CASE WHEN before LIKE '%\"' THEN '\"' ELSE '' END, {noise}, ' the') AS after", "label")


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> list[tuple[list[int], list[float], list[float]]]:
    """Complete trees in heap order: feature and threshold of each inner node, share of positives in each leaf."""
    rng, out = np.random.default_rng(seed), []
    width = x.shape[1]
    tries = max(3, round(width**0.5) + 1)
    for _ in range(trees):
        feature, cut, leaf = [0] * ((1 << depth) - 1), [float("inf")] * ((1 << depth) - 1), [0.0] * (1 << depth)
        todo = [(0, rng.integers(0, len(y), len(y)))]
        while todo:
            node, rows = todo.pop()
            share = float(y[rows].mean()) if len(rows) else 0.5
            if node >= len(feature):
                leaf[node - len(feature)] = share
                continue
            best = (np.inf, 0, np.inf)
            if 0 < share < 1:
                some = rng.permutation(width)[:tries]
                v, label = x[rows][:, some], y[rows]
                for t in v[rng.integers(0, len(rows), 8)]:  # every tried feature at the values of one finding
                    right = v > t
                    k = right.sum(0)
                    p = label @ right
                    q = label.sum() - p
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gini = np.where((k > 0) & (k < len(rows)), p * (1 - p / k) + q * (1 - q / (len(rows) - k)), np.inf)
                    if (at := int(np.nanargmin(gini))) >= 0 and gini[at] < best[0]:
                        best = (float(gini[at]), int(some[at]), float(t[at]))
            feature[node], cut[node] = best[1], best[2]
            right = x[rows, best[1]] > best[2]
            empty = rows if not right.any() or right.all() else None  # a pure node hands its rows to both sides
            todo += [(2 * node + 1, rows[~right] if empty is None else rows), (2 * node + 2, rows[right] if empty is None else rows)]
        out.append((feature, cut, leaf))
    return out


def forest(spark: SparkSession, trees: int = TREES, depth: int = DEPTH) -> list[tuple[list[int], list[float], list[float]]]:
    """The forest fitted on the labelled findings."""
    rows = labelled_findings(spark).select(features(F.col("value"), F.col("before"), F.col("after")).alias("x"), "label").collect()  # TRAINING_ROWS
    return fit_forest(np.array([r.x for r in rows]), np.array([r.label for r in rows], float), trees, depth)


@cache
def _forest_literal(trees: int, depth: int) -> str:
    fitted = forest(SparkSession.getActiveSession(), trees, depth)
    number = lambda v: "double('infinity')" if v == float("inf") else f"{v!r}D"
    return ", ".join(f"named_struct('f', array({', '.join(map(str, f))}), 't', array({', '.join(map(number, t))}), 'y', array({', '.join(map(number, y))}))" for f, t, y in fitted)


def forest_score(x: Column, trees: int = TREES, depth: int = DEPTH) -> Column:
    """Mean share of positives over the leaves that the features reach."""
    forest = F.expr(f"array({_forest_literal(trees, depth)})")

    def leaf(t: Column) -> Column:
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda n, _: 2 * n + 1 + (F.get(x, F.get(t["f"], n)) > F.get(t["t"], n)).cast("int"))
        return F.get(t["y"], walked - ((1 << depth) - 1))

    return F.aggregate(forest, F.lit(0.0), lambda s, t: s + leaf(t)) / float(trees)


def scored_findings(text: Column | str) -> Column:
    """The candidates of a text with their score."""
    numbered = F.transform(findings(text), lambda f: F.struct(f["value"].alias("value"), f["first"].alias("first"), features(f["value"], f["before"], f["after"]).alias("x")))
    return F.transform(numbered, lambda f: F.struct(f["value"].alias("value"), f["first"].alias("first"), forest_score(f["x"]).alias("score")))


def secrets(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per secret: doc_id, ordinal, first (code point), length, score, sha256 of its text."""
    found = docs.select("doc_id", F.filter(scored_findings("text"), lambda f: f["score"] >= threshold).alias("found")).select("doc_id", F.posexplode("found").alias("ordinal", "f"))
    return found.select("doc_id", "ordinal", F.col("f.first").alias("first"), F.length("f.value").cast("long").alias("length"), F.round("f.score", 6).alias("score"), F.sha2("f.value", 256).alias("secret_sha256"))


def redact(docs: DataFrame, mark: str = "[SECRET]", threshold: float = 0.5, column: str = "text") -> DataFrame:
    """The documents with every secret's text replaced by mark; all else as it was."""
    text = F.col(column)

    def piece(c: Column) -> Column:
        seen = F.struct(*(x.alias(n) for n, x in zip(("value", "before", "after"), _context(c), strict=True)))
        score = _let(_let(seen, lambda x: features(x["value"], x["before"], x["after"])), lambda x: forest_score(x))
        return F.concat(c["gap"], c["lead"], F.when(score >= threshold, F.lit(mark)).otherwise(c["value"]))

    whole = _let(_candidates(text), lambda found: F.concat(F.array_join(F.transform(found, piece), ""), F.element_at(found, -1)["next"]))
    return docs.withColumn(column, F.when(_may_hold_one(text), whole).otherwise(text))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read(spark, sf_dir, "documents"))
