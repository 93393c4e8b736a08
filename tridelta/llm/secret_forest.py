"""Secret scan: pattern candidates, of which a random forest keeps the real ones.

Candidates are the whole values that are assigned to a keyword (any characters
but white space and quotes, from ``VALUE`` on; quoted or not, after = : or =>),
the passwords in URLs, and runs of key characters in the whole text: long ones
anywhere, shorter ones where something is assigned. A forest trained from labelled
findings removes false positives; it looks at the candidate's length, its
character classes and the transitions between them, its entropy, how much of
it and of its neighbours dictionary words cover, the path it was found under
and the words around it.

Everything is DataFrame and SQL functions. The trained trees are written out
as nested CASE expressions, so scoring (and redaction) is a map over each
document's own candidates: no candidate leaves its row, and a document with
very many needs no shuffle.

``fit`` takes labelled findings (value, before, after, path, label).
``labelled_sample`` makes them where nobody has labelled any: values of known
kinds, secrets and what is mistaken for them (``KINDS``), are planted between
pieces of ``contexts`` documents of the corpus, so a label says how the value was
made and not how it looks; hashes, UUIDs, paths, placeholders and encoded text
stand in the same places as keys. A quarter of the findings is held out
(``by_kind`` counts the hits there). Words before and after a candidate are those
of the text, whether candidates themselves or not. At most ``train_rows`` of each
label are used, those with the smallest hash.

Null and empty text: no candidates, text unchanged. Null path: the path
features are 0. Repeated rows give repeated findings. An empty table, or labels
of one kind only, gives a forest of none: every candidate then scores as the
share of positive labels, 0.5 without any. A corpus of few documents gives
every context several times. Very long texts are scanned whole. Columns of the input are kept in a
struct and cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

RUN = "[A-Za-z0-9+/_-]"
LONG, SHORT, VALUE = 16, 8, 4
KEYWORDS = "password|passwd|pwd|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer"
# the same words by their first letters, and a look at the first
KEYWORD = "(?=[pstacbPSTACB])(?i:p(?:ass(?:word|wd)|wd|rivate.?key)|secret|token|a(?:pi.?key|ccess.?key|uth)|credential|bearer)"
# what stands between a keyword and its value; bounded, as it is looked at from behind
ASSIGN = "[A-Za-z0-9_.-]{0,24}[\"'\\]]{0,2}[ \\t]{0,8}(?:=>|:=|[=:])[ \\t]{0,8}[\"'`]?"
IN_URL = "://[^\\s:/@]{1,64}:"
# What stands before any candidate is no run character, so that places within words
# are left at once; all but the long runs have a mark, or white space or a quote
# after a mark or white space, before them. The look-behinds of fixed length spare the others.
CANDIDATE = (
    f"(?<!{RUN})(?:(?<=[=:>]|[=:> \\t][ \\t\"'`])(?:"
    f"(?<=(?:=>|[=:])[ \\t]{{0,8}}[\"'`]?)(?<={KEYWORD}{ASSIGN})"
    f"(?:(?<=[\"'`])[^\\s\"'`]{{{VALUE},}}(?=[\"'`])|(?![=>])[^\\s\"'`]{{{VALUE - 1},}}[^\\s\"'`.,;:!?)\\]}}>])"
    f"|(?<=:)(?<={IN_URL})[^\\s/@\"'`]{{{VALUE},}}(?=@)"
    f"|(?<=[=:] ?[\"']?){RUN}{{{SHORT},{LONG - 1}}}+(?!{RUN}))|{RUN}{{{LONG},}}+)")
BEFORE, AFTER = 48, 24
BLOCK = 64
HARMLESS_PATH = "test|example|sample|demo|mock|fixture|doc"
PLACEHOLDER = "your|here|change|me|example|sample|dummy|todo|none|null|true|false|string|value|env|getenv|config|secret|token|password|key|api|x{3,}|\\*{3,}"
DIGEST_WORDS = "commit|revision|sha[0-9]*|md5|digest|checksum|hash|etag|uuid|guid|blob|integrity"

# --- fixed values: kinds of findings: (name, label, value in SQL, texts around it, with @ for the value) ---
_HEX, _B32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_B64, _PASS = _B62 + "+/", _B62 + "!#$%&*+-.^_~?"


def _sql(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(salt: str, low: int, high: int) -> str:
    return f"int({low} + pmod(xxhash64(seed, '{salt}'), {high - low + 1}))"


def _draw(alphabet: str, low: int, high: int, salt: str = "v") -> str:
    """So many characters, drawn by the row's seed."""
    return (f"array_join(transform(sequence(1, {_number(salt + 'n', low, high)}), i -> "
            f"substr({_sql(alphabet)}, int(1 + pmod(xxhash64(seed, '{salt}', i), {len(alphabet)})), 1)), '')")


def _words(low: int, high: int, between: str, salt: str = "w") -> str:
    """Words of the context document."""
    return (f"array_join(transform(sequence(1, {_number(salt + 'n', low, high)}), i -> "
            f"words[int(pmod(xxhash64(seed, '{salt}', i), size(words)))]), '{between}')")


def _one_of(*texts: str) -> str:
    return f"array({', '.join(_sql(t) for t in texts)})[int(pmod(xxhash64(seed, 'one'), {len(texts)}))]"


_ASSIGNED = ('token = "@"', "token=@", "api_key: @", "API_KEY='@'", '"secret": "@"', "access_token => '@'", "auth_token: @", "client_secret=@;")
_PASSWORDS = ('password = "@"', "password: @", "password=@", "pwd=@", "passwd = '@'", "DB_PASSWORD=@", "'password': '@'", "password:   @,")
_NAMED = ("id: @", "ref = @", "name: @", "value=@", "see @ for", "(@)", "@", "in @", '"@"', "file @")
_UUID = "concat_ws('-', " + ", ".join(_draw(_HEX, n, n, f"u{k}") for k, n in enumerate((8, 4, 4, 4, 12))) + ")"
KINDS = (
    ("aws key", 1, f"concat('AKIA', {_draw(_B32, 16, 16)})", ("@", "key @", "AWS_ACCESS_KEY_ID=@", "aws: @", "(@)", "use @ now")),
    ("aws secret", 1, _draw(_B64, 20, 40), ("AWS_SECRET_ACCESS_KEY=@", 'aws_secret_access_key = "@"', "secret_key: @")),
    ("hex token", 1, _draw(_HEX, 16, 64), _ASSIGNED),
    ("upper hex token", 1, f"upper({_draw(_HEX, 16, 64)})", _ASSIGNED),
    ("token", 1, _draw(_B62 + "_-", 16, 60), _ASSIGNED + ("Authorization: Bearer @",)),
    ("prefixed key", 1, f"concat({_one_of('ghp_', 'sk_live_', 'xoxb-', 'glpat-', 'AIza')}, {_draw(_B62, 20, 40)})", _ASSIGNED + ("@", "with @ set")),
    ("password", 1, _draw(_PASS, 8, 20), _PASSWORDS),
    ("plain password", 1, f"concat({_draw('abcdefghijklmnoprstuvwyz', 4, 9, 'p')}, {_draw('0123456789', 2, 5, 'd')}, {_draw('abcdefgh', 0, 4, 'q')})", _PASSWORDS),
    ("URL password", 1, _draw(_PASS, 6, 16), ("postgres://app:@@db/x", "https://user:@@host.org/a", "amqp://svc:@@mq:5672")),
    ("commit", 0, _draw(_HEX, 40, 40), ("commit @", "at revision @", "@", "fixed in @", "blob @", "merge: @", "see @.")),
    ("digest", 0, f"{_draw(_HEX, 32, 64)}", ("sha256:@", "sha256 = @", "md5: @", "checksum=@", "digest: @", "@", "etag: \"@\"", "hash = '@'")),
    ("bare digest", 0, f"sha2(string(seed), 256)", ("@", "file @", "(@)", "is @ now")),
    ("UUID", 0, _UUID, _NAMED + ("uuid: @", "guid = '@'")),
    ("path", 0, f"concat({_one_of('/usr/lib/', '/home/', 'src/', '/var/log/', 'https/')}, {_words(2, 6, '/')})", _NAMED + ("from @", "path=@")),
    ("slug", 0, _words(3, 7, "-"), _NAMED + ("/@",)),
    ("snake name", 0, _words(2, 6, "_"), _NAMED + ("secret_name: @", "token = @")),
    ("long word", 0, _words(2, 6, ""), _NAMED),
    ("word in capitals", 0, f"upper({_words(1, 6, '')})", _NAMED),
    ("constant", 0, f"upper({_words(2, 5, '_')})", _NAMED + ("@ = 1", "@=x")),
    ("number", 0, _draw("0123456789", 8, 24), _NAMED + ("card @", "phone: @")),
    ("grouped number", 0, f"concat_ws('-', {', '.join(_draw('0123456789', 4, 4, f'g{k}') for k in range(4))})", _NAMED),
    ("placeholder", 0, _one_of("changeme", "change_me_please", "YOUR_API_KEY", "your-token-here", "<your_token_here>", "********", "xxxxxxxxxxxxxxxx",
                               "${SECRET}", "${DB_PASSWORD}", "{{ api_key }}", "os.environ", "getenv(TOKEN)", "None", "null", "string", "example_password",
                               "TODO_SET_THIS", "config.token", "process.env.API_KEY", "self.password", "dummy-secret-value"), _ASSIGNED + _PASSWORDS),
    ("word after a keyword", 0, _words(1, 1, ""), ("password: @", "token: @", "the secret: @", "auth: @", "password = @")),
    ("encoded text", 0, f"rtrim('=', base64(encode({_words(3, 9, ' ')}, 'UTF-8')))", ("data:text/plain;base64,@", "@", "body: @", "content = \"@\"")),
)


def dictionary_regex(words: list[str]) -> str:
    """Matches the longest of the (lower-case) words at a place. Words that begin
    alike share those letters, so a place is compared with one letter of each
    kind and not with every word."""
    tree: dict = {}
    for word in sorted({w for w in words if w.isalpha() and len(w) > 1}):
        at = tree
        for letter in word:
            at = at.setdefault(letter, {})
        at[""] = {}
    return _tree_regex(tree) or "(?!)"


def _tree_regex(tree: dict) -> str:
    ends = [letter + _tree_regex(rest) for letter, rest in sorted(tree.items()) if letter]
    if not ends:
        return ""
    return f"(?:{'|'.join(ends)})" + "?" * ("" in tree)


def words_for_dictionary(texts: DataFrame, text_col: str = "text", size: int = 400) -> list[str]:
    """The ``size`` most frequent words of a reference text table (a parameter
    of the scan, not a statistic of what is scanned)."""
    words = texts.select(F.explode(F.split(F.lower(F.regexp_replace(text_col, r"[^\p{L}]+", " ")), " ")).alias("w"))
    return [r["w"] for r in words.where(F.length("w") > 1).groupBy("w").count()
            .orderBy(F.desc("count"), "w").limit(size).collect()]


def _coverage(value: str, words: str) -> str:
    """Share of ``value`` that dictionary words cover."""
    return (f"(1 - length(regexp_replace(lower({value}), {_sql(words)}, '')) / greatest(1, length({value})))")


def feature_sql(words: str) -> dict[str, str]:
    """Features of a candidate ``c`` (value, before, after, path), by name."""
    v = "c.value"

    def share(kind: str) -> str:
        return f"(length(regexp_replace({v}, '[^{kind}]', '')) / length({v}))"

    runs = " + ".join(f"regexp_count({v}, '{kind}+')" for kind in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]"))
    chars = f"split({v}, '')"
    entropy = (f"aggregate(array_distinct({chars}), 0D, (a, x) -> a - (length({v}) - length(replace({v}, x, ''))) / length({v})"
               f" * log2((length({v}) - length(replace({v}, x, ''))) / length({v})))")
    last_word = r"regexp_extract(c.before, '([^\\s]*)\\s*$', 1)"
    path = "lower(coalesce(c.path, ''))"
    return {
        "length": f"least(length({v}), 1000)",
        "lower": share("a-z"), "upper": share("A-Z"), "digit": share("0-9"), "hex": share("0-9a-f"),
        "transitions": f"(({runs} - 1) / length({v}))",
        "vowel_transitions": f"(regexp_count(lower({v}), '[aeiouy][bcdfghjklmnpqrstvwxz]') / length({v}))",
        "entropy": entropy,
        "covered": _coverage(v, words),
        "covered_before": _coverage("c.before", words),
        "covered_after": _coverage("c.after", words),
        "keyword_before": f"int(lower(c.before) rlike {_sql('(' + KEYWORDS + ')')})",
        "keyword_word": f"int(lower({last_word}) rlike {_sql('(' + KEYWORDS + ')')})",
        "keyword_assigned": f"int(lower(c.before) rlike {_sql(f'(?:(?:{KEYWORDS}){ASSIGN}|{IN_URL})$')})",
        "assigned": r"""int(c.before rlike '[=:]>?\\s*["\']?$')""",
        "quoted": r"""int(c.before rlike '["\']$' and c.after rlike '^["\']')""",
        "apart": r"""int((c.before = '' or c.before rlike '[\\s"\'=:]$') and (c.after = '' or c.after rlike '^[\\s"\'.,;]'))""",
        "dashes": f"(length({v}) - length(replace({v}, '-', '')))",
        "slashes": f"(length({v}) - length(replace({v}, '/', '')))",
        "code": share("$(){}<>*\\\\[\\\\]"),
        "placeholder": _coverage(v, PLACEHOLDER),
        "digest_before": f"int(lower(c.before) rlike {_sql('(' + DIGEST_WORDS + ')[^a-z]*$')})",
        "prefix": f"int({v} rlike '^(AKIA|AIza|[a-z]{{2,5}}_|[a-z]{{2,5}}-[A-Za-z0-9]{{16}})')",
        "path_depth": f"(length({path}) - length(replace({path}, '/', '')))",
        "path_harmless": f"int({path} rlike {_sql('(' + HARMLESS_PATH + ')')})",
    }


def with_candidates(docs: DataFrame, text_col: str = "text", path_col: str | None = "source",
                    keep: list[str] | None = None) -> DataFrame:
    """row, hits, parts (the text between hits) and cands (structs), per row."""
    keep = docs.columns if keep is None else keep
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), path.alias("path"),
                       F.col(f"`{text_col}`").alias("text"),
                       F.regexp_extract_all(f"`{text_col}`", F.lit(CANDIDATE), F.lit(0)).alias("hits"))
    rows = rows.withColumn("parts", F.when(F.size("hits") > 0, F.split("text", CANDIDATE, -1)))
    # before and after run through neighbouring hits; so many of at least VALUE characters are always enough
    back, ahead = -(-BEFORE // VALUE), -(-AFTER // VALUE)
    rows = rows.withColumn("befores", F.expr(f"transform(hits, (h, i) -> concat(right(parts[i], {BEFORE}), right(h, {BEFORE})))"))
    rows = rows.withColumn("afters", F.expr(f"transform(hits, (h, i) -> concat(left(h, {AFTER}), left(parts[i + 1], {AFTER})))"))
    # both are used twice, so that the optimiser does not write them out within the loop
    return rows.withColumn("cands", F.expr(
        "transform(slice(hits, 1, least(size(befores), size(afters))), (h, i) -> named_struct('value', h, "
        f"'before', right(concat(array_join(slice(befores, greatest(1, i + 1 - {back}), least(i, {back})), ''), parts[i]), {BEFORE}), "
        f"'after', left(concat(left(parts[i + 1], {AFTER}), array_join(slice(afters, i + 2, {ahead}), '')), {AFTER}), "
        "'path', path, 'pos', i))"))


@dataclass(frozen=True)
class Forest:
    """A trained forest as SQL over a struct ``f`` of features."""

    words: str
    sql: str

    def score_sql(self, cands: str = "cands") -> str:
        fields = ", ".join(f"'{name}', double({sql})" for name, sql in feature_sql(self.words).items())
        return f"transform(transform({cands}, c -> named_struct({fields})), f -> {self.sql})"


def _tree_sql(node, names: list[str]) -> str:
    """Nested CASE of a tree; leaves give the share of positive labels."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return repr(float(stats[1] / sum(stats)) if sum(stats) else 0.5) + "D"
    split = node.split()
    return (f"CASE WHEN f.{names[split.featureIndex()]} <= {split.threshold()!r}D THEN {_tree_sql(node.leftChild(), names)} "
            f"ELSE {_tree_sql(node.rightChild(), names)} END")


def fit(labelled: DataFrame, words: str, trees: int = 20, depth: int = 6, train_rows: int = 20_000,
        seed: int = 11) -> Forest:
    """``labelled``: value, before, after, path, label (0 or 1)."""
    features = feature_sql(words)
    picked = None
    for label in (0, 1):  # a bounded number of each label, the same in every run
        part = (labelled.where(F.col("label") == label)
                .orderBy(F.xxhash64("value", "before", "after", F.lit(seed)), "value", "before", "after").limit(train_rows))
        picked = part if picked is None else picked.unionByName(part)
    rows = store(picked.select(F.struct("value", "before", "after", "path").alias("c"), F.col("label").cast("double").alias("label"))
                 .select("label", *(F.expr(sql).cast("double").alias(name) for name, sql in features.items())), "secret-training")
    kinds = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return Forest(words, repr(float(next(iter(kinds), 0.5))) + "D")
    names = list(features)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data)
    parts = [_tree_sql(t._java_obj.rootNode(), names) for t in model.trees]
    return Forest(words, "((" + ") + (".join(parts) + f")) / {len(parts)}D")


def labelled_sample(docs: DataFrame, text_col: str = "text", path_col: str | None = "source", contexts: int = 400) -> DataFrame:
    """Findings (value, before, after, path, label, kind, held_out): a value of
    every kind, planted into each of ``contexts`` documents (those with the
    smallest hash), between two pieces of its text."""
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit(None).cast("string")
    texts = docs.select(F.col(f"`{text_col}`").alias("text"), path.alias("path")).where("text <> ''")
    picked = store(texts.orderBy(F.xxhash64("text", "path"), "text", "path").limit(contexts), "secret-contexts")
    rounds = -(-contexts // max(1, picked.count()))
    words = "filter(split(lower(regexp_replace(text, '[^A-Za-z]+', ' ')), ' '), w -> length(w) > 1)"
    rows = (picked.withColumn("words", F.expr(f"concat({words}, if(size({words}) = 0, array('word'), cast(array() as array<string>)))"))
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(KINDS) * rounds - 1))))
            .withColumn("seed", F.xxhash64("text", "path", "k")).withColumn("kind", F.expr(f"k % {len(KINDS)}")))

    def by_kind_sql(of) -> str:
        return "CASE kind " + " ".join(f"WHEN {n} THEN {of(kind)}" for n, kind in enumerate(KINDS)) + " END"

    form = by_kind_sql(lambda kind: f"array({', '.join(_sql(t) for t in kind[3])})[int(pmod(xxhash64(seed, 'form'), {len(kind[3])}))]")
    rows = rows.withColumn("value", F.expr(by_kind_sql(lambda kind: kind[2]))).withColumn("form", F.expr(form))
    at = "int(1 + pmod(xxhash64(seed, '{0}'), greatest(1, length(text) - 60)))"
    planted = F.expr(f"concat(substr(text, {at.format('l')}, 60), ' ', left(form, locate('@', form) - 1), value, "
                     f"substr(form, locate('@', form) + 1), ' ', substr(text, {at.format('r')}, 60))")
    rows = rows.select("value", "path", "seed", F.expr(by_kind_sql(lambda kind: _sql(kind[0]))).alias("kind"),
                       F.expr(by_kind_sql(lambda kind: str(kind[1]))).alias("label"), planted.alias("text"))
    found = with_candidates(rows, "text", "path", ["value", "kind", "label", "seed"])
    found = found.select("row.*", F.explode_outer(F.expr("filter(cands, c -> c.value = row.value)")).alias("c")).where("c is not null")
    return found.select("c.value", "c.before", "c.after", "c.path", "label", "kind", (F.pmod("seed", F.lit(4)) == 2).alias("held_out"))


def by_kind(findings: DataFrame, forest: Forest, keep_at: float = 0.5) -> DataFrame:
    """kind, label, findings and those that the forest keeps, of the held-out ones."""
    rows = findings.where("held_out").withColumn("cands", F.array(F.struct("value", "before", "after", "path")))
    return (rows.withColumn("score", F.expr(forest.score_sql())[0]).groupBy("kind", "label")
            .agg(F.count("*").alias("findings"), F.sum((F.col("score") >= keep_at).cast("int")).alias("kept")))


def train(docs: DataFrame, words: str, text_col: str = "text", path_col: str | None = "source", contexts: int = 400, **options) -> Forest:
    found = store(labelled_sample(docs, text_col, path_col, contexts), "secret-findings")
    return fit(found.where("not held_out"), words, **options)


def scan(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = "source",
         keep: list[str] | None = None, keep_at: float = 0.5) -> DataFrame:
    """One row per finding that the forest keeps: row, start (characters before
    it), length, value, score."""
    rows = with_candidates(docs, text_col, path_col, keep).withColumn(
        "steps", F.expr("zip_with(slice(parts, 1, size(hits)), hits, (p, h) -> bigint(length(p) + length(h)))"))
    # where each hit ends: first the sums of whole blocks, so that a text of very many hits is not summed from its start for each
    rows = rows.withColumn("sums", F.expr(
        f"transform(sequence(0, size(steps) div {BLOCK}), b -> aggregate(slice(steps, b * {BLOCK} + 1, {BLOCK}), 0L, (a, n) -> a + n))"))
    rows = rows.withColumn("ends", F.expr(
        f"flatten(transform(transform(sums, (s, b) -> aggregate(slice(sums, 1, b), 0L, (a, n) -> a + n)), (s, b) -> "
        f"transform(slice(steps, b * {BLOCK} + 1, {BLOCK}), (n, i) -> aggregate(slice(steps, b * {BLOCK} + 1, i + 1), s, (a, n) -> a + n))))"))
    # scores and ends are what zip_with goes through: named within a loop, the optimiser may write them out there, once for each candidate
    found = F.expr("zip_with(zip_with(cands, " + forest.score_sql() + ", (c, s) -> named_struct('value', c.value, 'score', s)), ends, "
                   "(x, e) -> named_struct('value', x.value, 'score', x.score, 'start', e - length(x.value)))")
    out = rows.select("row", found.alias("found")).select("row", F.explode_outer(F.expr(f"filter(found, x -> x.score >= {keep_at}D)")).alias("x"))
    return out.where("x is not null").select("row", F.col("x.start").alias("start"), F.length("x.value").alias("length"),
                                             F.col("x.value").alias("value"), F.col("x.score").alias("score"))


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = "source",
           mark: str = "[SECRET]", keep_at: float = 0.5) -> DataFrame:
    """``docs`` with each kept finding replaced by ``mark``; all rows stay."""
    rows = with_candidates(docs, text_col, path_col)
    # as in scan, the scores are gone through and not looked up by number
    shown = f"zip_with(hits, {forest.score_sql()}, (h, s) -> if(s >= {keep_at}D, {_sql(mark)}, h))"
    clean = F.expr(f"concat(parts[0], array_join(zip_with({shown}, slice(parts, 2, size(hits)), (h, p) -> concat(h, p)), ''))")
    text = F.when(F.size("hits") > 0, clean).otherwise(F.col("text"))
    return rows.withColumn("clean", text).select(*(
        F.col("clean").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


