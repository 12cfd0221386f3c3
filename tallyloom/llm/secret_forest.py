"""Secret scans with a random forest that removes false positives; DataFrame and SQL functions only.

Candidates are private key blocks, what is assigned to a key word such as `password` (from six characters on), and other
runs of at least 16 key-like characters that hold a digit or two capitals; a run of lower-case letters alone, far from any
key word, is none. Each candidate is described by its length, the transitions between its character classes, its entropy,
the share of it that dictionary words cover, marks of paths and file names, and the words beside it. The forest is trained
by Spark ML on labelled findings, then written out as one SQL expression over the candidates of a text, so that scanning is
a narrow projection: nothing is shuffled to score. Every intermediate array is bound to a lambda variable, so that the
optimizer can't copy its definition into the next one: the work is in proportion to a text's length and candidates.

Labelled findings come as a table (candidate, before, after, label); without one, `labelled_findings` makes examples of
the usual kinds of secrets and of look-alikes (revisions, digests, uuids, card numbers, paths, identifiers, inline images,
placeholders, calls and words after a key word). The texts scanned play no part in training.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Names whose assigned value is a candidate whatever its form.
_NAME = "(?=[acpstACPST])(?i:a(?:pi[_-]?key|ccess[_-]key|uth[_-]token)|credential|p(?:ass(?:word|wd|phrase)|wd|rivate[_-]key)|secret(?:[_-]key)?|token)"
_TO = r"[\"'`]?[ \t]{0,2}(?::=|=>|[=:])[ \t]{0,2}[\"'`]?"
_RUN = r"[A-Za-z0-9+/=_.\-]"
_VALUE = r"[^\s\"'`,;<>]{5,}[^\s\"'`,;<>.)]"
#: A key of any length; its body has no dash, so the search for its end goes as far as the next one, once.
_BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
#: A match is a key block, a name with what is assigned to it, or a run.
CANDIDATE = rf"{_BLOCK}|{_NAME}{_TO}{_VALUE}|(?<!{_RUN})(?={_RUN}{{16}})(?={_RUN}*[0-9]|{_RUN}*[A-Z]{_RUN}*[A-Z]){_RUN}{{16,}}"
#: The name at the beginning of such a match, and where nothing at all can match.
_ASSIGNMENT, _ANY = rf"^{_NAME}{_TO}", rf"(?<!{_RUN}){_RUN}{{16}}|PRIVATE KEY-----|{_NAME}{_TO}"
# Common words and name parts whose cover of a candidate speaks against a random key.
DICTIONARY = "the and for with from this that have about your user name file data test example sample value index page item list time date version release build report image photo video document download upload update config setting default main lib src bin usr var home local share site package module class function method string number object array table column row record service server client request response message event error warning info debug admin account customer product order invoice payment final draft copy backup archive public private static content style script font icon logo required optional none null true false string field param argument input output below above here see enter change reset forgot confirm current new old valid invalid expired missing policy manager provider header parameter variable environment process env get set self return import export length world people state city house water school company group system program problem hand part place week month year day night right left high low small large long short good great little own other same able bad early young important few next last first".split()
# Words beside a candidate that speak for, and against, a secret.
KEY_WORDS = "token secret passw pwd passphrase apikey api_key api-key access_key credential auth bearer private_key client_key signing"
HASH_WORDS = "commit sha1 sha256 sha-1 sha-256 md5 digest checksum etag revision hash uuid guid build base64 image/ card order invoice isbn serial fingerprint"

_WORDS = "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))
_any = lambda words: "|".join(w.replace("-", "[-]") for w in words.split())

#: Features of a candidate: SQL over c (candidate), b (lower-cased text before it), a (text after it).
FEATURES = {
    "size": "length(c)",
    "runs": r"length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '[a-z]+', '\u0001'), '[A-Z]+', '\u0002'), '[0-9]+', '\u0003'), '[^\u0001-\u0003]+', '\u0004')) / length(c)",
    "letter_digit": "regexp_count(c, '[A-Za-z](?=[0-9])') / length(c)",
    "digit_letter": "regexp_count(c, '[0-9](?=[A-Za-z])') / length(c)",
    "lower_upper": "regexp_count(c, '[a-z](?=[A-Z])') / length(c)",
    "upper_lower": "regexp_count(c, '[A-Z](?=[a-z])') / length(c)",
    "vowel_steps": "regexp_count(lower(c), '[aeiou](?=[bcdfghj-np-tv-z])') / length(c)",
    "digits": "regexp_count(c, '[0-9]') / length(c)",
    "uppers": "regexp_count(c, '[A-Z]') / length(c)",
    "hex": "regexp_count(c, '[0-9a-fA-F]') / length(c)",
    "marks": "regexp_count(c, '[+/=_.-]') / length(c)",
    "distinct": "size(array_distinct(split(c, ''))) / least(length(c), 64)",
    "entropy": "aggregate(array_distinct(split(c, '')), 0D, (s, x) -> s - (length(c) - length(replace(c, x, ''))) / length(c) * log2((length(c) - length(replace(c, x, ''))) / length(c)))",
    "covered": f"1 - length(regexp_replace(lower(c), '{_WORDS}', '')) / length(c)",
    "slashes": "regexp_count(c, '/')",
    "dots": "regexp_count(c, '[.]')",
    "dashes": "regexp_count(c, '[-_]')",
    "extension": r"int(c rlike '[.](?:[a-z]{2,4}|[a-z0-9]{3})$')",
    "in_path": r"int(b rlike '(?:[/\\\\]|https?:|www[.])[^ ]*$' or a rlike '^[/\\\\]')",
    "uuid": "int(lower(c) rlike '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')",
    "prefix": "int(c rlike '^(?:gh[pousr]_|github_pat_|sk[-_]|xox[abp]-|AKIA|AIza|glpat-|eyJ)')",
    "key_word": f"int(b rlike '(?:{_any(KEY_WORDS)})[^\\n]{{0,12}}$' or c rlike '(?i)^(?:{_any(KEY_WORDS)})')",
    "hash_word": f"int(b rlike '(?:{_any(HASH_WORDS)})[^\\n]{{0,12}}$')",
    "assigned": r"int(b rlike '[=:] ?[\"\']?$')",
    "quoted": r"int(b rlike '[\"\'`]$' and a rlike '^[\"\'`]')",
    "placeholder": "int(lower(c) rlike 'example|your|xxxx|sample|placeholder|dummy|0000|1234|changeme')",
    "specials": "regexp_count(c, '[^A-Za-z0-9+/=_.-]') / length(c)",
    "code": r"int(c rlike '[(){}$\\[\\]]|^[A-Za-z_]+([.][A-Za-z_]+)+$|^[*.x•-]+$')",
    "one_case": "int(c rlike '^([a-z]+|[A-Z][a-z]+)[.!?]?$')",
    "key_block": "int(c rlike '^-----BEGIN ')",
}


def _sql(text: str) -> str:
    """A SQL string literal's inside."""
    return text.replace("\\", "\\\\").replace("'", "\\'")


def labelled_findings(spark: SparkSession, rows: int = 150, first: int = 0) -> DataFrame:
    """`rows` examples of each kind, from number `first` on: candidate, before, after, label (1: a secret). The same on every call."""
    hexes = "sha2(concat(kind, '-', id), 256)"
    b64 = f"base64(unhex({hexes}))"
    b62 = f"translate({b64}, '+/=', 'aK7')"
    word = lambda k: f"element_at(array('the','of','in','reads','with','this','value','here','is','was','then','and'), int(pmod(hash(id, {k}), 12) + 1))"
    name = lambda k: f"element_at(array('user','report','index','data','final','config','image','module','release','service'), int(pmod(hash(kind, id, {k}), 10) + 1))"
    prose = f"concat({word(1)}, ' ', {word(2)}, ' ', {word(3)}, ' ')"
    pick = lambda *options: f"element_at(array({', '.join(repr(o) for o in options)}), int(pmod(hash(kind, id), {len(options)}) + 1))"
    quote = "\""
    term = lambda k: f"element_at(array('correct','horse','battery','staple','purple','monkey','dish','river','stone','summer','winter','tiger','coffee','planet','silver','garden'), int(pmod(hash(kind, id, {k}), 16) + 1))"
    assign = pick("password: ", f"password = {quote}", "pwd=", f"passwd: {quote}", "token: ", f"secret = {quote}", "api_key=", f"'passphrase': {quote}")
    kinds = [  # candidate, what stands directly before, directly after, label
        (f"substr({hexes}, 1, 40)", pick(f"token = {quote}", f"token={quote}", f"auth_token: {quote}", f"access token = {quote}"), f"'{quote}'", 1),
        (f"substr({hexes}, 1, 32)", pick(f"api_key = {quote}", "apikey: ", f"API_KEY={quote}", "secret: "), pick(quote, " "), 1),
        (hexes, pick(f"secret = {quote}", f"client_secret: {quote}", "signing secret "), pick(quote, " "), 1),
        (f"substr({b62}, 1, 20 + int(pmod(hash(id), 12)))", pick("password: ", f"password = {quote}", "pwd=", f"passwd: {quote}"), pick(" ", quote), 1),
        (f"concat('ghp_', substr({b62}, 1, 36))", pick("", "with ", "use ", "token "), pick(" ", ".", quote), 1),
        (f"concat('AKIA', upper(substr({b62}, 1, 16)))", pick("", "key ", "id = "), pick(" ", quote), 1),
        (f"concat('sk-', substr({b62}, 1, 40))", pick("", f"key = {quote}", "using "), pick(" ", quote), 1),
        (f"concat('eyJ', substr({b62}, 1, 20), '.eyJ', substr({b62}, 8, 30), '.', substr({b62}, 1, 30))", pick("Bearer ", f"token: {quote}", "jwt "), pick(" ", quote), 1),
        (b64, pick(f"credential = {quote}", "auth: ", f"access_key={quote}"), pick(quote, " "), 1),
        (f"substr({hexes}, 1, 40)", pick("commit ", "revision ", "sha1 ", "sha1: ", "at commit "), pick(" ", ".", ","), 0),
        (hexes, pick("sha256:", "sha256 ", "digest ", "checksum = "), pick(" ", "."), 0),
        (f"substr({hexes}, 1, 32)", pick("md5 ", "md5: ", "etag ", "checksum "), pick(" ", "."), 0),
        (f"substr({hexes}, 1, 40)", pick("", "see ", "build "), pick(" ", ","), 0),
        (f"regexp_replace({hexes}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}}).*', '$1-$2-$3-$4-$5')", pick("id ", "uuid ", "", "request ", f"id: {quote}"), pick(" ", quote), 0),
        (f"lpad(string(pmod(xxhash64(kind, id), 10000000000000000)), 16, '7')", pick("", "card ", "order ", "number "), pick(" ", "."), 0),
        (f"concat('/usr/lib/', {name(1)}, '/', {name(2)}, '-', int(pmod(hash(id), 90)), '/', {name(3)}, '.txt')", pick("", "in ", "file "), pick(" ", "."), 0),
        (f"concat({name(1)}, '/', {name(2)}, '/', {name(3)}, int(pmod(hash(id), 900)))", pick("https://example.org/", "http://www.example.com/a/"), pick(" ", "/"), 0),
        (f"concat({name(1)}, '_', {name(2)}, '_', {name(3)}, '_', int(pmod(hash(id), 900)))", pick("", "call ", "def ", "name = "), pick("(", " "), 0),
        (f"concat({name(1)}, '-20', 10 + int(pmod(hash(id), 15)), '-0', 1 + int(pmod(hash(id, 2), 9)), '.v', int(pmod(hash(id), 9)), '.pdf')", pick("", "file "), pick(" ", "."), 0),
        (f"concat('iVBORw0KGgo', {b64}, {b64})", pick("data:image/png;base64,", "image/gif;base64,"), pick(quote, " "), 0),
        (f"concat(element_at(array('your-api-key-', 'example_token_', 'xxxxxxxxxxxx', 'changeme-please-', 'sample-secret-'), int(pmod(hash(id), 5) + 1)), '12345')", pick(f"token = {quote}", "api_key: ", f"password={quote}"), pick(quote, " "), 0),
        (f"concat('+', string(pmod(xxhash64(id, kind), 1000000)), '-', string(pmod(hash(id), 100000)), '-555-', lpad(string(pmod(hash(id, 9), 10000)), 4, '3'))", pick("phone ", "call ", ""), pick(" ", "."), 0),
        (f"concat(substr({b62}, 1, 6 + int(pmod(hash(id), 9))), element_at(array('!', '@', '#', '&', '%', '?'), int(pmod(hash(id, 3), 6) + 1)), substr({b62}, 20, int(pmod(hash(id, 5), 4))))", assign, pick(quote, " ", ""), 1),
        (f"concat({term(1)}, int(pmod(hash(id), 9000)), element_at(array('', '!', '@', '$$', '_'), int(pmod(hash(id, 3), 5) + 1)))", assign, pick(quote, " "), 1),
        (f"concat({term(1)}, {term(2)}, {term(3)}, {term(4)})", assign, pick(quote, " "), 1),
        (f"upper(substr(translate({b64}, '0123456789+/=', 'qwertzuiopasd'), 1, 16 + int(pmod(hash(id), 16))))", pick("api key ", f"key = {quote}", "API_KEY: ", f"access key {quote}"), pick(quote, " "), 1),
        (f"concat('-----BEGIN ', element_at(array('', 'RSA ', 'EC ', 'OPENSSH '), int(pmod(hash(id), 4) + 1)), 'PRIVATE KEY-----\\n', IF(pmod(id, 3) = 0, '', {b64}), IF(pmod(id, 3) = 0, '', '\\n-----END PRIVATE KEY-----'))", pick("", "key: ", "file "), pick(" ", ""), 1),
        (f"element_at(array('required', 'optional', 'string', 'invalid', 'missing', 'expired', 'should', 'incorrect', 'always', 'never', 'something', 'changed', 'policy', 'reset.', 'strength', 'expires', 'please', 'Forgot', 'Required.', 'nothing'), int(pmod(hash(id, 4), 20) + 1))", assign, pick(" ", "."), 0),
        (f"concat(element_at(array('get', 'read', 'load', 'self.', 'os.environ[', 'config.', 'process.env.', 'request.', '{{', '${{'), int(pmod(hash(id, 6), 10) + 1)), {name(1)}, element_at(array('()', '(x)', '.value', ']', '_name', '}}'), int(pmod(hash(id, 7), 6) + 1)))", assign, pick(" ", quote), 0),
        (f"repeat(element_at(array('*', '.', 'x', '-'), int(pmod(id, 4) + 1)), 6 + int(pmod(hash(id), 10)))", assign, pick(quote, " "), 0),
        (f"concat({word(1)}, '-', {name(1)}, '-', {word(2)}, '-', upper({name(2)}))", pick("", "the ", "a "), pick(" ", "."), 0),
        (f"concat(upper({name(1)}), '_', upper({name(2)}), '_', upper({name(3)}))", pick("", "set ", "const "), pick(" ", "="), 0),
    ]
    parts = []
    for k, (candidate, before, after, label) in enumerate(kinds):
        base = spark.range(first, first + rows, 1, 1).select("id", F.lit(f"k{k}").alias("kind"))
        parts.append(base.selectExpr(f"{candidate} AS candidate", f"concat({prose}, {before}) AS before", f"concat({after}, ' ', {word(4)}) AS after", f"{label} AS label"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.coalesce(1)


def feature_columns(findings: DataFrame) -> DataFrame:
    own = findings.filter("candidate is not null and candidate <> '' and label is not null").selectExpr("candidate AS c", "lower(coalesce(before, '')) AS b", "coalesce(after, '') AS a", "double(label) AS label")
    return own.selectExpr("label", *(f"double({e}) AS {n}" for n, e in FEATURES.items()))


def _tree_sql(node, names: list[str]) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return repr(round(stats[1] / sum(stats), 6)) + "D"
    split = node.split()
    return f"IF(f.{names[split.featureIndex()]} <= {split.threshold()!r}D, {_tree_sql(node.leftChild(), names)}, {_tree_sql(node.rightChild(), names)})"


def train_forest(labelled: DataFrame, trees: int = 24, depth: int = 7, seed: int = 9) -> tuple[str, int]:
    """The forest as SQL over a struct f of FEATURES: the mean of the trees' shares of secrets. And its number of trees."""
    names = list(FEATURES)
    table = VectorAssembler(inputCols=names, outputCol="x").transform(feature_columns(labelled)).select("x", "label")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(table)
    parts = [_tree_sql(t.rootNode(), names) for t in model._java_obj.trees()]
    return f"({' + '.join(parts)}) / {len(parts)}D", len(parts)


def _let(value: str, name: str, body: str) -> str:
    """body with a name for value, which is evaluated once: a lambda's variable is never replaced by its definition."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Candidates whose starts are summed up together, so that sums stay in proportion to their number.
_RUN_OF_SUMS = 128


def findings_sql(text: str, forest: str, cut: float) -> str:
    """SQL of array<struct(start, length, candidate, score, is_secret)> and the pieces between: struct(found, pieces); null where there is none."""
    r, n = _sql(CANDIDATE), _RUN_OF_SUMS
    split = f"named_struct('m', regexp_extract_all(t.t, '{r}', 0), 'p', split(t.t, '{r}', -1))"
    # An assignment's name goes to the piece before it.
    named = _let(f"transform(s.m, m -> regexp_extract(m, '{_sql(_ASSIGNMENT)}', 0))", "k", "named_struct('c', transform(s.m, (m, i) -> substr(m, length(k[i]) + 1)), 'p', transform(s.p, (p, i) -> concat(p, coalesce(get(k, i), ''))))")
    sized = "named_struct('c', w.c, 'p', w.p, 'n', transform(w.c, (c, i) -> bigint(length(w.p[i]) + length(c))))"
    summed = f"named_struct('c', z.c, 'p', z.p, 'n', z.n, 'b', aggregate(sequence(0, (size(z.n) - 1) div {n}), cast(array(0L) as array<bigint>), (acc, b) -> array_append(acc, element_at(acc, -1) + aggregate(slice(z.n, int(b * {n} + 1), {n}), 0L, (g, h) -> g + h))))"
    fields = ", ".join(f"'{name}', double({_inside(e)})" for name, e in FEATURES.items())
    place = f"u.b[int(i div {n})] + aggregate(slice(u.n, int((i div {n}) * {n} + 1), int(i % {n})), 0L, (g, h) -> g + h) + length(u.p[i])"
    one = _let("named_struct('c', c, 'b', lower(right(u.p[i], 64)), 'a', left(u.p[i + 1], 32))", "x", _let(f"named_struct({fields})", "f", forest))
    scored = _let(one, "score", f"named_struct('start', bigint({place}), 'length', bigint(length(c)), 'candidate', c, 'score', score, 'is_secret', score > {cut}D)")
    body = _let(split, "s", _let(named, "w", _let(sized, "z", _let(summed, "u", f"named_struct('found', transform(u.c, (c, i) -> {scored}), 'pieces', u.p)"))))
    return _let(f"named_struct('t', {text})", "t", f"IF(t.t rlike '{_sql(_ANY)}', {body}, NULL)")


def _inside(expression: str) -> str:
    """A feature's SQL with c, b and a read from the struct x."""
    out = []
    for k, part in enumerate(re.split(r"('(?:[^'\\]|\\.)*')", expression)):
        out.append(part if k % 2 else re.sub(r"(?<![\w.])([abc])(?![\w(])", r"x.\1", part).replace("(s, x)", "(s, y)").replace("replace(x.c, x,", "replace(x.c, y,"))
    return "".join(out)


def secret_findings(df: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", *, trees: int = 24, depth: int = 7, cut: float = 0.5) -> DataFrame:
    """One row for each candidate: doc_id, start, length, candidate, score, is_secret.

    Null, empty and candidate-free texts give no row; repeated rows each give theirs. Labelled rows with a null candidate
    or label are left out; with one class only, all candidates get that class.
    """
    forest, _ = train_forest(labelled_findings(df.sparkSession) if labelled is None else labelled, trees, depth)
    # explode_outer of the bare expression: no predicate on it is inferred, so it is evaluated once for each text.
    every = documents(df, id_col, text_col).select("doc_id", F.explode_outer(F.expr(f"({findings_sql('text', forest, cut)}).found")).alias("x"))
    return every.filter("x is not null").select("doc_id", "x.*")


def redact(df: DataFrame, labelled: DataFrame | None = None, text_col: str = "text", *, mark: str = "[secret]", trees: int = 24, depth: int = 7, cut: float = 0.5) -> DataFrame:
    """df with every secret in its text column replaced by `mark`; all rows and other columns stay. Null stays null."""
    forest, _ = train_forest(labelled_findings(df.sparkSession) if labelled is None else labelled, trees, depth)
    found = findings_sql("r.text", forest, cut)
    kept = f"array_join(transform(f.pieces, (p, i) -> concat(p, IF(coalesce(get(f.found, i).is_secret, false), '{_sql(mark)}', coalesce(get(f.found, i).candidate, '')))), '')"
    clean = _let("named_struct('text', string(_text))", "r", _let(found, "f", f"IF(exists(f.found, x -> x.is_secret), {kept}, r.text)"))
    work = df.select(F.col(text_col).alias("_text"), F.struct("*").alias("_row")).select(F.expr(clean).alias("_clean"), "_row")
    return work.select(*((F.col("_clean") if c == text_col else F.col("_row")[c]).alias(c) for c in df.columns))
