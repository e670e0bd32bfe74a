"""Folders as sources: scans, ignore rules and secrets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import content_hash
from . import folder as folder_tree
from .stores import written

#: Names and paths that hold secrets.
SECRET_PATHS = [".kube/config", ".docker/config.json"]
SECRET_PATH_PREFIXES = [".ssh/", ".gnupg/", ".aws/", ".kube/", ".docker/"]
SECRET_NAMES = [".env", ".ssh", ".gnupg", ".aws", ".kube", ".docker", ".netrc", ".npmrc", ".pypirc"]
SECRET_NAME_PREFIXES = [".env.", "id_rsa", "id_ecdsa", "id_ed25519"]
SECRET_NAME_SUFFIXES = [".pem", ".key", ".p12", ".pfx", ".keystore", ".tfstate"]
SECRET_NAME_PARTS = [".tfstate."]
SUSPECT_PARTS = ["credentials", "secret", "token", "apikey", "password"]


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def secret_tier(path: Column) -> Column:
    """A for names and paths that are known to hold secrets, B for suspicious names, else null."""
    p = F.lower(F.replace(F.regexp_replace(path, "^/+", ""), F.lit("\\"), F.lit("/")))
    name = F.element_at(F.split(p, "/"), -1)
    a = p.isin(SECRET_PATHS) | any_of([p.startswith(x) for x in SECRET_PATH_PREFIXES]) | name.isin(SECRET_NAMES)
    a = a | any_of([name.startswith(x) for x in SECRET_NAME_PREFIXES] + [name.endswith(x) for x in SECRET_NAME_SUFFIXES] + [F.contains(name, F.lit(x)) for x in SECRET_NAME_PARTS])
    return F.when(a, "A").when(any_of([F.contains(name, F.lit(x)) for x in SUSPECT_PARTS]), "B")


def glob_regex(pattern: str) -> str:
    """``*`` within a part, ``?`` one character, ``**`` across parts; a pattern without a slash is for the last part of the path."""
    body, anchored = pattern.rstrip("/"), "/" in pattern.rstrip("/")
    out, i = "", 0
    body = body.removeprefix("/")
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.sub(r"([^\w/])", r"\\\1", body[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}$"


def ignored(path: Column, is_dir: Column, rules: list[str], fold: bool = False) -> Column:
    """Ordered rules, the last that matches wins; ``!`` negates, a final slash is for folders only, # begins a comment."""
    out = F.lit(False)
    p = F.lower(path) if fold else path
    for rule in rules:
        if not rule.strip() or rule.startswith("#"):
            continue
        negated, pattern = rule.startswith("!"), rule.removeprefix("!")
        regex = glob_regex(pattern.lower() if fold else pattern)
        hit = p.rlike(regex) & (is_dir if pattern.endswith("/") else F.lit(True))
        out = F.when(hit, F.lit(not negated)).otherwise(out)
    return out


def last_rule(path: Column, is_dir: Column, rules: list[str]) -> Column:
    """True where the last rule that matches takes a path in, False where it leaves it out, null where none matches."""
    out = F.lit(None).cast("boolean")
    for rule in rules:
        if rule.strip() and not rule.startswith("#"):
            pattern = rule.removeprefix("!")
            out = F.when(path.rlike(glob_regex(pattern)) & (is_dir if pattern.endswith("/") else F.lit(True)), F.lit(rule.startswith("!"))).otherwise(out)
    return out


def scan_allows(relative: Column, rules: list[str] = ()) -> Column:
    """Whether a scan would take up a file at this relative path: no rule leaves it or a folder above it out, and it is no known secret."""
    hidden, tier, _ = _judged(relative, list(rules))
    return ~hidden & F.coalesce(tier != "A", F.lit(True))


def _judged(relative: Column, rules: list[str]) -> tuple[Column, Column, Column]:
    """Of a relative path: whether it is ignored, its secret tier, and whether a rule takes it in by name; folders above it count for the first two."""
    parts = F.split(relative, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    hidden = F.exists(above, lambda p: ignored(p, F.lit(True), rules)) | ignored(relative, F.lit(False), rules)
    tier = F.array_min(F.array_compact(F.concat(F.transform(above, secret_tier), F.array(secret_tier(relative)))))
    return hidden, tier, F.coalesce(last_rule(relative, F.lit(False), rules), F.lit(False))


class Rules:
    """The rules of one scope as two automata, for files and for folders: alternatives from the last rule to the first, so that the one that matches is the last that does."""

    def __init__(self, rules: list[str]):
        patterns = [(r.startswith("!"), r.removeprefix("!")) for r in rules if r.strip() and not r.startswith("#")]
        self.automata = []
        for for_folders in (False, True):
            some = [(taken, glob_regex(p)[1:-1]) for taken, p in reversed(patterns) if for_folders or not p.endswith("/")]
            self.automata.append((re.compile("|".join(f"({p})" for _, p in some)) if some else None, [taken for taken, _ in some]))

    def ignores(self, path: str, is_dir: bool) -> bool:
        automaton, taken = self.automata[is_dir]
        hit = automaton.fullmatch(path) if automaton else None
        return hit is not None and not taken[hit.lastindex - 1]

    def hides(self, path: str) -> bool:
        """Whether a file, or a folder above it, is ignored."""
        ends = [i for i, c in enumerate(path) if c == "/"]
        return any(self.ignores(path[:i], True) for i in ends) or self.ignores(path, False)


def ignored_by_scope(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` (scope_id, relative, ...) with ``ignored`` by their scope's rules (scope_id, ord, rule), the last that matches winning.

    A scope's rules travel with its files as one list and are compiled once a task. Scopes without
    rules, and null ids, ignore nothing. Null paths are not ignored.
    """
    of = rules.groupBy(F.col("scope_id").alias("_scope")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rule"))), lambda x: x["rule"]).alias("_rules"))
    rows = files.join(of, files["scope_id"] == F.col("_scope"), "left").drop("_scope")
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Rules] = {}
        for b in batches:
            out = []
            for path, own in zip(b.column("relative").to_pylist(), b.column("_rules").to_pylist(), strict=True):
                key = tuple(own or ())
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = Rules(list(key))
                out.append(path is not None and known[key].hides(path))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out, pa.bool_())], [*names, "ignored"])

    return rows.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("ignored", T.BooleanType())]))


#: Why a file is held back.
QUARANTINE = {"excluded": "secrets_tier_a_excluded", "held": "secrets_tier_a_online_hold", "warned": "secrets_tier_b_warning"}


def scan_folder(spark: SparkSession, folder: str, rules: list[str] = (), *, recursive: bool = False, contents: bool = False, most_bytes: int = 64 << 20) -> DataFrame:
    """Files of a folder: path, name, relative (the path below the folder), size_bytes, modified, ignored, secret_tier, quarantine, and with ``contents`` content and raw_hash.

    Files of every name are listed, also those that begin with . or _. Rules and secrets are
    tested on the relative path and on each folder in it: what lies in an ignored folder is ignored,
    whatever later rules say of the file, and what lies in a secret folder is secret. quarantine:
    a known secret is excluded, or held where a rule with ! takes it in by name; a suspicious name is
    a warning. With ``contents`` files that are ignored or excluded are left out: they are not opened.
    Contents of files that are gone since, or larger than ``most_bytes``, are null. They are read in parts of even
    size, whatever folders hold.
    """
    folder_tree.register(spark)
    files = spark.read.format(folder_tree.FORMAT).option("recursive", str(recursive).lower()).load(folder)
    hidden, tier, named = _judged(F.col("relative"), list(rules))
    rows = files.select("path", F.element_at(F.split("relative", "/"), -1).alias("name"), "relative", "size_bytes", "modified", hidden.alias("ignored"), tier.alias("secret_tier"), named.alias("_named"))
    excluded = F.col("ignored") | ~F.col("_named")
    reason = F.when(F.col("secret_tier") == "A", F.when(excluded, QUARANTINE["excluded"]).otherwise(QUARANTINE["held"])).when(F.col("secret_tier") == "B", QUARANTINE["warned"])
    rows = rows.withColumn("quarantine", reason).drop("_named")
    return with_contents(rows.where(~_closed()), folder, most_bytes) if contents else rows


def _closed() -> Column:
    """Whether a file of a scan may not be opened."""
    return F.col("ignored") | F.coalesce(F.col("quarantine") == QUARANTINE["excluded"], F.lit(False))


def with_contents(rows: DataFrame, folder: str, most_bytes: int = 64 << 20) -> DataFrame:
    """The rows of a scan with content and raw_hash; excluded files are not opened."""
    closed = _closed()
    read = lambda batches: folder_tree.contents(batches, folder, most_bytes)
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])
    opened = rows.where(~closed).repartition(F.xxhash64("path")).mapInArrow(read, schema)
    both = opened.unionByName(rows.where(closed).withColumn("content", F.lit(None).cast("binary")))
    return both.withColumn("raw_hash", F.when(F.col("content").isNotNull(), content_hash(F.col("content"))))


def rescan(spark: SparkSession, folder: str, stored: DataFrame, rules: list[str] = (), *, most_bytes: int = 64 << 20) -> DataFrame:
    """A recursive scan against a stored listing (relative, size_bytes, modified, raw_hash): the listing now, with change.

    Only files that are new, or whose size or time differs, are opened and hashed; the others keep
    their stored hash. change: added, changed (another hash), touched (the same hash),
    unchanged, or removed. Files that may not be opened have a null hash.
    """
    now = scan_folder(spark, folder, rules, recursive=True)
    old = stored.select("relative", F.col("size_bytes").alias("_size"), F.col("modified").alias("_time"), F.col("raw_hash").alias("_hash"))
    met = now.join(old, "relative", "left")
    same = F.col("_hash").isNotNull() & (F.col("size_bytes") == F.col("_size")) & (F.col("modified") == F.col("_time"))
    known = written(met.withColumn("_same", same))
    kept = known.where("_same").select(*now.columns, F.col("_hash").alias("raw_hash"), F.lit("unchanged").alias("change"))
    again = with_contents(known.where("not _same").select(*now.columns, "_size", "_hash"), folder, most_bytes)
    kind = F.when(F.col("_size").isNull(), "added").when(F.col("raw_hash").eqNullSafe(F.col("_hash")), "touched").otherwise("changed")
    found = kept.unionByName(again.select(*now.columns, "raw_hash", kind.alias("change")))
    gone = old.join(known.select("relative"), "relative", "left_anti").select("relative", F.col("_size").alias("size_bytes"), F.col("_time").alias("modified"), F.col("_hash").alias("raw_hash"), F.lit("removed").alias("change"))
    return found.unionByName(gone, allowMissingColumns=True)


def child_scopes(spark: SparkSession, folder: str, *, version_control: bool = False) -> DataFrame:
    """Folders below ``folder`` that hold files; what lies in a folder of version control only with ``version_control``."""
    files = scan_folder(spark, folder, recursive=True)
    parent = F.regexp_replace("path", "/[^/]*$", "")
    plain = files if version_control else files.where(~F.concat(F.lit("/"), F.col("relative")).rlike(r"/(\.git|\.hg|\.svn|CVS|_darcs)/"))
    return plain.groupBy(parent.alias("scope_path")).agg(F.count(F.lit(1)).alias("files"))


def verified(files: DataFrame) -> DataFrame:
    """Rows whose bytes have the hash that is expected of them (content, raw_hash)."""
    return files.where(content_hash(F.col("content")) == F.col("raw_hash"))


def in_scope(root: Column, path: str, descendants: bool) -> Column:
    """The scope itself, or with its descendants at a border of path parts."""
    return (root == path) | root.startswith(f"{path.rstrip('/')}/") if descendants else root == path
