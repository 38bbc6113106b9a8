"""Private or secret text in the files of a repository: where it is and of what kind, never the text itself.

`python -m palaver.sources.repository FOLDER [EXPORT]` lists the findings and ends with 1 if there are any. EXPORT is a private chat whose names, numbers,
links and messages must not turn up either.
"""

from __future__ import annotations

import os
import re
import subprocess
import sys
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import export

# What is looked for in each line (Java expressions), by kind.
KINDS = {
    "phone": r"(?<!U)\+\d(?:[\s\-().]?\d){7,14}|(?<![\d.\-/:+])\d{10}(?![\d.\-/:])",
    "invite": r"(?i)(?:chat\.whatsapp\.com|wa\.me)/\S*",
    "url": r"(?i)https?://[^\s/)>\]\"'`]+",
    "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "key": r"sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9-]{10,}|hf_[A-Za-z0-9]{30,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "assignment": r"(?i)\b(?:password|passwd|secret|api[_-]?key|token)\b\s*[:=]\s*['\"][^'\"\s]{6,}['\"]",
}
# What marks a match as made up.
FICTIONAL_NUMBERS = ("0000", "9000", "11111", "22222", "33333", "44444", "88888", "99999", "12345", "6789", "98765", "555 010", "5550100", "2345 6789")
FICTIONAL_LINKS = ("FICTIONAL", "AAA", "BBB", "DEMO", "EXAMPLE", "XYZ", "ABC", "SECRETCODE")
# Hosts that may be named.
HOSTS = ("example.com", "example.org", "example.net", "localhost", "127.0.0.1", "github.com", "python.org", "pypi.org", "unicode.org", "w3.org", "opensource.org")
# Files that are no text, and names that must not be committed.
NO_TEXT = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".ico", ".pyc")
NEVER = r"(?i)(?:^|/)WhatsApp Chat|(?<!sample)_chat\.txt$|(?:^|/)data/chat\.txt$|\.zip$|(?:^|/)local_private/|(?:^|/)\.env$|\.pem$"


def candidates(folder: str, everything: bool = False) -> list[str]:
    """Files that a commit would hold; all files where there is no repository."""
    if not everything:
        listed = subprocess.run(["git", "ls-files", "--cached", "--others", "--exclude-standard", "-z"], cwd=folder, capture_output=True, text=True, check=False)
        if listed.returncode == 0:
            return sorted(p for p in listed.stdout.split("\0") if p and os.path.isfile(os.path.join(folder, p)))
    return sorted(os.path.relpath(os.path.join(at, n), folder) for at, _, names in os.walk(folder) if not {".git", "__pycache__"} & set(at.split(os.sep)) for n in names)


def _excused(kind: str, match: Column) -> Column:
    """True for a match that is no finding; only the match itself is looked at."""
    any_of = lambda words: "|".join(map(re.escape, words))
    host = F.lower(F.regexp_extract(match, r"(?i)https?://([^:]*)", 1))
    code = F.regexp_extract(match, r"/(\S*)$", 1)
    return {
        "phone": match.rlike(any_of(FICTIONAL_NUMBERS)),
        "invite": (F.char_length(code) <= 3) | code.rlike(r"^[.`…]") | F.upper(code).rlike(any_of(FICTIONAL_LINKS)),
        "url": host.isin("chat.whatsapp.com", "wa.me") | host.rlike(rf"^(?:.*\.)?(?:{any_of(HOSTS)})$"),
        "email": F.lower(match).rlike(r"@(?:example\.|mail\.com|users\.noreply\.github\.com)"),
    }.get(kind, F.lit(False))


def private_strings(spark: SparkSession, path: str) -> DataFrame:
    """kind, value: names, numbers, links and messages of a private export, in lower case."""
    m, _ = export.read_export(spark, path)
    said = F.lower(F.trim("message"))
    rows = F.array(
        F.struct(F.lit("private sender").alias("kind"), F.when(~F.col("sender").rlike(r"\d{5}"), F.lower("sender")).alias("value")),
        F.struct(F.lit("private message").alias("kind"), F.when((F.char_length(said) >= 20) & ~F.col("is_media") & ~F.col("is_deleted"), said).alias("value")),
    )
    found = lambda kind, pattern, c: F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    text = F.lower(F.concat_ws(" ", "sender", "message"))
    links = F.transform(F.regexp_extract_all(text, F.lit(r"(?:https?://|www\.)\S+"), F.lit(0)), lambda v: F.struct(F.lit("private link").alias("kind"), F.rtrim(v, F.lit(".,)")).alias("value")))
    every = F.concat(F.when(F.col("message_type") == "user", rows).otherwise(F.slice(rows, 1, 0)), found("private number", r"\+\d[\d \-]{7,}\d", text), links)
    return m.select(F.inline(every)).where("value is not null and value <> ''").distinct()


def _members(path: str) -> list[str]:
    """The texts in an archive; none if it can't be read."""
    try:
        with zipfile.ZipFile(path) as z:
            return [z.read(n).decode("utf-8", "ignore") for n in z.namelist()]
    except (zipfile.BadZipFile, OSError):
        return []


def scan(spark: SparkSession, folder: str, files: list[str] | None = None, private: str | None = None) -> DataFrame:
    """file, line_no, kind: a row for each finding; line 0 for a file that must not be committed. Files inside archives are read too, their lines numbered through."""
    files = candidates(folder) if files is None else files
    names = spark.createDataFrame([(f,) for f in files], "file string").where(F.col("file").rlike(NEVER)).select("file", F.lit(0).cast("long").alias("line_no"), F.lit("file").alias("kind"))
    texts = [f for f in files if not f.lower().endswith((*NO_TEXT, ".zip"))]
    whole = spark.createDataFrame([(f, "\n".join(_members(os.path.join(folder, f)))) for f in files if f.lower().endswith(".zip")], "file string, value string")
    if texts:
        where = spark.createDataFrame([(os.path.realpath(os.path.join(folder, f)), f) for f in texts], "_path string, file string")
        read = spark.read.format("binaryFile").load([p[0] for p in where.select("_path").collect()]).select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), F.try_validate_utf8(F.col("content").cast("string")).alias("value"))
        whole = whole.unionByName(read.join(where, "_path").select("file", "value").where("value is not null"))
    lines = whole.select("file", F.posexplode(F.split("value", "\n", -1)).alias("at", "line")).select("file", (F.col("at") + 1).cast("long").alias("line_no"), "line")
    found = lambda kind, p: F.transform(F.filter(F.regexp_extract_all("line", F.lit(p), F.lit(0)), lambda m: ~_excused(kind, m)), lambda _: F.lit(kind))
    hits = lines.select("file", "line_no", F.explode(F.concat(*[found(k, p) for k, p in KINDS.items()])).alias("kind"))
    out = names.unionByName(hits)
    if private and os.path.exists(private):
        secrets = private_strings(spark, private)
        low = lines.withColumn("_low", F.lower("line")).where("_low <> ''")
        out = out.unionByName(low.join(secrets, F.contains("_low", "value")).select("file", "line_no", "kind").distinct())
    return out


def main(argv: list[str]) -> int:
    session = SparkSession.builder.getOrCreate()
    found = scan(session, argv[0], private=argv[1] if len(argv) > 1 else None).orderBy("file", "line_no", "kind").collect()
    for r in found:
        print(f"{r['file']}:{r['line_no']}: {r['kind']}")
    print(f"findings: {len(found)}")
    return 1 if found else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
