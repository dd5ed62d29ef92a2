"""Secret scan: candidates by shape, false positives removed by a random forest.

All of it is DataFrame and SQL functions and Spark's own forest. A candidate is any value of four
characters or more that a key word (password, token, ... in four languages) gives with = or : or =>, or beside
it in a list; a quoted one whole, of three characters or more; the password of an address, what
follows "bearer", a block of a private key; and any run of at least ``MIN_LENGTH`` letters, digits and
_+/=- with a digit or both cases in it, or of capitals, runs joined by full stops being one. Features: length and shares of character kinds, transitions between kinds, how much of it
dictionary words cover, what it looks like as a path or a placeholder, the document's own path, and
the words before and after. The forest learns from labelled
findings (before, value, after, path, label); ``labelled_findings`` makes a set of them by rule.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_LENGTH = 16
_RUN = r"[A-Za-z0-9_+/=\-]"
_KEY = r"(?:token|secret|passw(?:or)?d|passwd|pwd|passphrase|passwort|kennwort|contrase[ñn]a|clave|mot[ _-]de[ _-]passe|mdp|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|(?<![A-Za-z])key)"
_BEFORE_VALUE = rf"(?i:{_KEY})[\w\-]{{0,12}}[\x22']?\]?[\x20\t]{{0,3}}(?:=>|[=:])\s{{0,3}}"
_BESIDE = rf"[\x22'](?i:{_KEY})[\x22'],\x20{{0,2}}"
_QUOTED = rf"(?<=[\x22'])(?:(?<=[=:>]\s{{0,3}}.)(?<={_BEFORE_VALUE}.)|(?<=,\x20{{0,2}}.)(?<={_BESIDE}.))[^\n\x22']{{3,120}}(?=[\x22'])"
_GIVEN = rf"(?<=[=:>]\s{{0,3}})(?<={_BEFORE_VALUE})[^\s\x22'=:,;<>()]{{4,}}"
_ADDRESS = r"(?<=:)(?<=://[^\s/:@]{1,64}:)[^\s/@]{3,}(?=@)"
_BEARER = r"(?<=\s)(?<=(?i:bearer)\s)[A-Za-z0-9_+/=\-.]{12,}"
_BLOCK = r"-----BEGIN\x20[A-Z\x20]{0,24}PRIVATE\x20KEY-----[^-]{16,}+-----END\x20[A-Z\x20]{0,24}PRIVATE\x20KEY-----"
_MIXED = rf"(?={_RUN}{{{MIN_LENGTH}}})(?:[A-Z]{{{MIN_LENGTH}}}|[A-Za-z_+/=\-]*+[0-9]|[A-Z]*+[a-z]++[A-Z])"
_LONG = rf"(?<!{_RUN})(?=(?:[A-Za-z0-9_\-]{{2,12}}\.)?{_MIXED})(?<!{_RUN}\.)(?:{_RUN}{{{MIN_LENGTH},}}|[A-Za-z0-9_\-]{{2,12}}\.(?={_RUN}{{{MIN_LENGTH},}}\.{_RUN}{{{MIN_LENGTH}}}){_RUN}{{{MIN_LENGTH},}})(?:\.{_RUN}{{{MIN_LENGTH},}}+)*+"
CANDIDATE = rf"{_BLOCK}|{_QUOTED}|{_GIVEN}|{_ADDRESS}|{_BEARER}|{_LONG}"
#: What every text with a candidate has, without looking back from each of its places.
HINTS = (rf"[=:>](?<={_BEFORE_VALUE})", rf"(?<!{_RUN}){_MIXED}", _BESIDE, r"://[^\s/:@]{1,64}:[^\s/@]{3,}@", r"(?i)bearer\s[A-Za-z0-9_+/=\-.]{12}", r"PRIVATE\x20KEY-----")
BEFORE, AFTER = 48, 24
#: Put about candidates to cut texts at, a character that stands for none; in a text it counts as U+FFFD.
_MARK = "\uFDD0"

#: Words that stand in names, not in secrets; coverage by them speaks against a secret.
DICTIONARY = (
    "account", "action", "admin", "album", "archive", "article", "asset", "backup", "build", "cache", "chapter", "class", "client", "config",
    "content", "count", "data", "date", "default", "demo", "detail", "document", "download", "draft", "edition", "event", "example", "export",
    "feature", "field", "file", "final", "folder", "format", "frame", "function", "gallery", "group", "guide", "handler", "header", "history",
    "image", "import", "index", "input", "invoice", "issue", "item", "label", "layer", "layout", "letter", "level", "library", "list", "local",
    "main", "manual", "member", "message", "model", "module", "month", "name", "network", "number", "object", "option", "order", "output",
    "package", "page", "panel", "part", "photo", "picture", "plugin", "point", "post", "product", "profile", "project", "public", "query",
    "record", "release", "report", "request", "resource", "result", "sample", "screen", "script", "section", "server", "service", "session",
    "setting", "source", "status", "string", "style", "summary", "system", "table", "template", "test", "theme", "thumbnail", "time", "title",
    "topic", "update", "upload", "user", "value", "version", "video", "view", "volume", "widget", "window", "world", "year",
)
_KEYED = r"(?i)(token|secret|passw(or)?d|passwd|pwd|passphrase|passwort|kennwort|contrase[ñn]a|clave|mot[ _-]de[ _-]passe|mdp|://[^\s/:@]{1,64}:|\bkey|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth(orization)?|bearer|credential)"
#: What stands where a secret is to be put.
_PLACEHOLDER = r"(?i)your|example|change|placeholder|dummy|sample|x{4}|\*{3}|\.{3}|\$[{(]?|%[sd(]|^(null|none|nil|true|false|undefined|empty|required|optional|string|value|redacted|hidden|process|os|env|config)\b"
_HASHED = r"(?i)(sha-?(1|256|512)?|md5|commit|checksum|digest|etag|revision|integrity|uuid|guid|isbn|order|invoice|tracking)"

FEATURES = (
    "length", "digits", "uppers", "lowers", "others", "vowels", "distinct", "hex", "kind_changes", "case_changes", "repeats",
    "covered", "spaces", "block", "in_address", "slashes", "hyphens", "specials", "dots", "placeholder", "dotted_after", "url_before", "test_path", "keyed", "assigned", "quoted", "hashed",
)


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, start, end, value, before, after, path): start and end in code points, end exclusive."""
    path = docs[path_col].cast("string") if path_col else F.lit(None).cast("string")
    text = F.col("text")
    hinted = text.rlike(HINTS[0])
    for hint in HINTS[1:]:
        hinted = hinted | text.rlike(hint)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.coalesce(path, F.lit("")).alias("path")).filter(hinted)
    # one pass over a text: what is found stands at every other place of the cut text
    cut = F.split(F.regexp_replace(F.translate("text", _MARK, "\uFFFD"), CANDIDATE, f"{_MARK}$0{_MARK}"), _MARK, -1)
    cut_rows = rows.select("doc_id", "path", cut.alias("cut"), F.monotonically_increasing_id().alias("row")).filter(F.size("cut") > 1)
    parts = cut_rows.select("doc_id", "path", "row", F.filter("cut", lambda x, i: i % 2 == 1).alias("found"), F.filter("cut", lambda x, i: i % 2 == 0).alias("between"))
    zipped = F.zip_with(F.col("found"), F.slice("between", F.lit(1), F.size("found")), lambda v, b: F.struct(v.alias("value"), F.right(b, F.lit(BEFORE)).alias("before"), F.length(b).alias("gap")))
    after = F.transform(F.slice("between", F.lit(2), F.size("found")), lambda x: F.left(x, F.lit(AFTER)))
    each = parts.select("doc_id", "path", "row", F.posexplode(F.arrays_zip(zipped.alias("z"), after.alias("after"))).alias("k", "x")).select("doc_id", "path", "row", "k", "x.z.value", "x.z.before", "x.z.gap", "x.after")
    end = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("row").orderBy("k"))
    return each.withColumn("end", end.cast("int")).select("doc_id", (F.col("end") - F.length("value")).alias("start"), "end", "value", "before", "after", "path")


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def with_features(found: DataFrame, dictionary: tuple[str, ...] = DICTIONARY) -> DataFrame:
    """Adds the columns FEATURES to rows with value, before, after and path."""
    v, before, after, path = (F.col(c) for c in ("value", "before", "after", "path"))
    left_over = F.length(F.regexp_replace(F.lower(v), "|".join(sorted(dictionary, key=len, reverse=True)), ""))
    columns = {
        "length": F.length(v).cast("double"),
        "digits": _share("[0-9]"),
        "uppers": _share("[A-Z]"),
        "lowers": _share("[a-z]"),
        "others": _share(r"[_+/=\-]"),
        "vowels": _share("[aeiouAEIOU]"),
        "distinct": F.size(F.array_distinct(F.regexp_extract_all(v, F.lit("(?s)."), F.lit(0)))) / F.length(v),
        "hex": _flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$") & v.rlike("[a-fA-F]")),
        "kind_changes": _share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"),
        "case_changes": _share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "repeats": _share(r"(.)(?=\1)"),
        "covered": 1 - left_over / F.length(v),
        "spaces": F.regexp_count("value", F.lit(r"\s")).cast("double"),
        "block": _flag(v.startswith("-----BEGIN")),
        "in_address": _flag(before.rlike(r"://[^\s/:@]{1,64}:$") & after.startswith("@")),
        "slashes": F.regexp_count("value", F.lit("/")).cast("double"),
        "hyphens": F.regexp_count("value", F.lit("-")).cast("double"),
        "specials": _share(r"[^A-Za-z0-9_+/=\-.]"),
        "dots": F.regexp_count("value", F.lit(r"\.")).cast("double"),
        "placeholder": _flag(v.rlike(_PLACEHOLDER)),
        "dotted_after": _flag(after.rlike(r"^\.[a-z]{2,4}\b")),
        "url_before": _flag(before.rlike(r"(?i)(https?:|www\.|\.(com|org|net)/?|[/\\.@])\S{0,40}$")),
        "test_path": _flag(path.rlike(r"(?i)(^|[/_.-])(tests?|examples?|fixtures?|docs?|samples?|mocks?)([/_.-]|$)")),
        "keyed": _flag(before.rlike(_KEYED + r"\W{0,6}\w{0,16}\W{0,6}$")),
        "assigned": _flag(before.rlike(r"([=:]|=>)\s*[\"']?$")),
        "quoted": _flag(before.rlike(r"[\"']$") & after.rlike("^[\"']")),
        "hashed": _flag(before.rlike(_HASHED + r"\W{0,4}\w{0,8}\W{0,4}$")),
    }
    return found.select("*", *[c.alias(n) for n, c in columns.items()])


def labelled_findings(spark: SparkSession, rows: int = 8000) -> DataFrame:
    """(before, value, after, path, label) by rule from row numbers; ``rows`` bounds the set."""
    h = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 512)
    hexed = F.substring(h, F.lit(1), F.element_at(F.array(*[F.lit(n) for n in (20, 32, 40, 64)]), (F.col("id") % 4 + 1).cast("int")))
    mixed = F.translate(F.substring(F.base64(F.unhex(h)), F.lit(3), F.element_at(F.array(*[F.lit(n) for n in (20, 24, 36, 44)]), (F.col("id") % 4 + 1).cast("int"))), "=", "7")
    figures = F.lpad(F.regexp_replace(h, "[a-f]", ""), 20, "8")
    words = F.array(*[F.lit(w) for w in DICTIONARY])

    def word(k: int) -> Column:
        return F.element_at(words, (F.pmod(F.hash("id", F.lit(k)), F.lit(len(DICTIONARY))) + 1).cast("int"))

    several = F.element_at(F.array(*[F.lit(n) for n in (8, 10, 12, 14)]), (F.col("id") % 4 + 1).cast("int"))
    short = F.concat(F.substring(F.base64(F.unhex(h)), F.lit(5), several), F.element_at(F.array(*map(F.lit, ("!", "#1", "", "_7", "@z", ".Q"))), (F.pmod(F.hash("id", F.lit(55)), F.lit(6)) + 1).cast("int")))
    mild = F.concat(word(1), F.substring(figures, 1, 3))
    letters = F.translate(F.substring(F.base64(F.unhex(h)), F.lit(3), F.lit(28)), "0123456789+/=", "qWxYzKvJpRmLt")
    dotted = F.concat_ws(".", F.substring(F.base64(F.unhex(h)), 1, 22), F.substring(F.base64(F.unhex(F.sha2(h, 512))), 1, 40), F.translate(F.substring(F.base64(F.unhex(F.sha2(h, 256))), 1, 27), "+/", "-_"))
    capital = F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4)))
    empty = F.element_at(F.array(*map(F.lit, ("null", "None", "undefined", "required", "changeme", "********", "${PASSWORD}", "string", "your-password", "xxxxxxxx", "<hidden>", "process.env.KEY"))), (F.pmod(F.hash("id", F.lit(66)), F.lit(12)) + 1).cast("int"))
    named = F.concat_ws("_", word(1), word(2), word(3), F.substring(figures, 1, 3))
    dashed = F.regexp_replace(F.substring(h, 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    kinds = [  # before, value, after, path, label
        ('{w} token = "', hexed, '" {w}', "src/app.py", 1),
        ("api_key: ", mixed, " {w}", "config/prod.yml", 1),
        ("password='", mixed, "'", "deploy.sh", 1),
        ("Authorization: Bearer ", mixed, " {w}", "", 1),
        ('secret="', hexed, '"', "", 1),
        ("access_key = ", mixed, "", "", 1),
        ("commit ", hexed, " {w}", "CHANGES.md", 0),
        ("sha256: ", hexed, "", "lock.txt", 0),
        ("{w} {w} the ", F.substring(figures, 1, 16), " {w} {w}", "", 0),
        ("{w} of ", named, " {w}", "src/names.py", 0),
        ("https://www.example.com/", F.concat_ws("/", word(1), word(2), named), ".html", "", 0),
        ("uuid: ", dashed, ",", "data.json", 0),
        ("{w} ", F.concat(word(4), F.lit("-"), word(5), F.lit("-2024-10-01")), ".png", "docs/index.md", 0),
        ("{w} ", F.concat(F.repeat(F.lit("="), 20), F.lit("1")), "", "", 0),
        ('token = "', F.concat(F.lit("your_"), word(6), F.lit("_token_here_123")), '"', "examples/demo.py", 0),
        ('{w} password = "', short, '"', "app.cfg", 1),
        ("pwd: ", short, " {w}", "", 1),
        ("passwd=", mild, "", "", 1),
        ("api_key=", letters, " {w}", "", 1),
        ("token: ", dotted, " {w}", "", 1),
        ("{w} ", dotted, "", "", 1),
        ("secret_key = '", mixed, "'", "settings.py", 1),
        ("password: ", word(5), " {w}", "", 0),
        ("token = ", empty, " {w}", "", 0),
        ('password="', empty, '"', "docs/setup.md", 0),
        ("api_key: ", F.upper(F.concat(F.lit("your_"), word(6), F.lit("_key"))), "", "", 0),
        ("secret: the ", word(1), " {w}", "", 0),
        ("{w} ", capital, "(", "src/main.java", 0),
        ("{w} {w} ", capital, " {w}", "", 0),
        ("import ", F.concat_ws(".", F.lit("org"), F.concat(word(1), word(2), word(3), F.lit("123456")), F.concat(word(4), word(5), word(6), F.lit("impl"))), ";", "src/main.java", 0),
        ("password: ", F.concat_ws("-", word(1), word(2)), " {w}", "docs/index.md", 0),
        ('{w} {w} ', F.concat(word(1), word(2), F.substring(figures, 1, 2), word(3)), " {w}", "", 0),
        ("postgres://{w}:", short, "@db.{w}/main", "config/app.yml", 1),
        ("https://{w}:", mixed, "@{w}.net/", "", 1),
        ("ftp://{w}:", empty, "@{w}.net/", "docs/setup.md", 0),
        ("Bearer ", letters, " {w}", "", 1),
        ("{w} key = ", letters, "", "", 1),
        ("{w} ", F.upper(letters), " {w}", "", 1),
        ("{w} ", F.upper(capital), " {w}", "", 0),
        ('password => "', short, '"', "app.rb", 1),
        ('"password", "', short, '"', "app.py", 1),
        ('"token", "', F.concat_ws(" ", word(1), word(2)), '"', "src/names.py", 0),
        ('password="', F.concat_ws(" ", word(1), short), '"', "", 1),
        ('secret = "', F.concat_ws(" ", F.lit("the"), word(1), word(2)), '"', "", 0),
        ("password:\n  ", short, "", "deploy.yml", 1),
        ("Passwort: ", short, " {w}", "", 1),
        ("contraseña = ", mild, "", "", 1),
        ("mot de passe : ", short, "", "", 1),
        ("clave: ", word(5), " {w}", "", 0),
        ("key: ", word(6), " {w}", "", 0),
        ("", F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.base64(F.unhex(h)), F.lit("\n-----END RSA PRIVATE KEY-----")), "", "id_rsa", 1),
    ]
    made = [F.struct(*[F.regexp_replace(F.lit(x), r"\{w\}", word(7 + k)).alias(n) if n in ("before", "after") else (F.lit(x) if not isinstance(x, Column) else x).alias(n) for n, x in zip(("before", "value", "after", "path", "label"), kind, strict=True)]) for k, kind in enumerate(kinds)]
    return spark.range(rows).select(F.element_at(F.array(*made), (F.pmod(F.hash("id", F.lit(99)), F.lit(len(kinds))) + 1).cast("int")).alias("x")).select("x.*")


def fit_forest(labelled: DataFrame, *, trees: int = 32, depth: int = 9, seed: int = 11) -> RandomForestClassificationModel:
    """A forest over the features of labelled findings (null texts as empty)."""
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("before", "value", "after", "path")]
    rows = _assembled(with_features(labelled.select(*texts, F.col("label").cast("double").alias("label"))))
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(rows.select("features", "label"))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def secret_scan(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, start, end, value, score, is_secret (score >= threshold).

    Null and empty texts have no candidates; texts are scanned whole. Repeated rows, and repeated
    candidates within a text, are each reported. A null id is kept as null. Empty table: no rows.
    """
    model = fit_forest(labelled)
    found = _assembled(with_features(candidates(docs, id_col=id_col, text_col=text_col, path_col=path_col)))
    scored = model.transform(found).select("doc_id", "start", "end", "value", vector_to_array("probability")[1].alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= threshold)
