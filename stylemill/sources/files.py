"""Sources: archives, text files, DOCX, lists and JSON; and the profile store."""

from __future__ import annotations

import io
import re
import tarfile
import unicodedata
import xml.etree.ElementTree as ElementTree
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.lines import voice_filter

TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".rst", ".rtf", ".html", ".htm", ".tex", ".csv")
TAR_SUFFIXES = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")
MOST_FILES, MOST_BYTES, LEAST_CHARS = 2000, 2_000_000, 200
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(raw: bytes) -> str:
    """UTF-8 with or without a mark, else cp1252, else latin-1."""
    for kind in ("utf-8-sig", "cp1252", "latin-1"):
        try:
            return raw.decode(kind)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def docx_text(raw: bytes) -> str:
    """S3: the paragraphs that aren't empty, one a line."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paras = ("".join(t.text or "" for t in p.iter(_W + "t")) for p in root.iter(_W + "p"))
    return "\n".join(p for p in paras if p.strip())


def members(path: str, raw: bytes, most: int = MOST_BYTES) -> Iterator[tuple[str, bytes]]:
    """Names and leading bytes of an archive's files; DOCX files are whole, for a part of one can't be read."""
    cut = lambda name: -1 if name.lower().endswith(".docx") else most
    low = path.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for i in sorted(z.infolist(), key=lambda i: i.filename):
                if not i.is_dir():
                    with z.open(i) as f:
                        yield i.filename, f.read(cut(i.filename))
    elif low.endswith(TAR_SUFFIXES):
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for m in sorted((m for m in t.getmembers() if m.isfile()), key=lambda m: m.name):
                yield m.name, t.extractfile(m).read(cut(m.name))
    else:
        raise ValueError(f"not an archive: {path}")


def read_corpus(spark: SparkSession, path: str, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES, least: int = LEAST_CHARS, voiced: bool = False) -> DataFrame:
    """Path, text of the text and DOCX files under a folder, inside archives too, cleaned; voiced: by the voice filter as well.

    Files that can't be read and texts of under `least` characters are left out; of the rest the first `most_files` by path.
    """

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, raw in zip(batch["path"], batch["content"], strict=True):
                out = []
                try:
                    files = list(members(p, raw, most_bytes)) if p.lower().endswith((".zip", *TAR_SUFFIXES)) else [("", raw if p.lower().endswith(".docx") else raw[:most_bytes])]
                except (zipfile.BadZipFile, tarfile.TarError, OSError):
                    continue
                for name, data in files:
                    full = f"{p}!{name}" if name else p
                    try:
                        if full.lower().endswith(TEXT_SUFFIXES):
                            out.append((full, decode(data)))
                        elif full.lower().endswith(".docx"):
                            out.append((full, docx_text(data)))
                    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                        continue
                yield pd.DataFrame(out, columns=["path", "text"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = raw.mapInPandas(texts, "path string, text string")
    rows = rows.select("path", T.strip_base64_images(T.normalize("text")).alias("text"))
    # a text's length counts once its filters are through
    rows = (voice_filter(rows, "path") if voiced else rows).where(F.length("text") >= least)
    return rows.orderBy("path").limit(most_files)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Value, line: lines without comments and blanks."""
    lines = spark.read.text(path).select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("value"))
    return lines.where("value <> ''")


def read_common_words(spark: SparkSession, path: str) -> DataFrame:
    """Word, zipf of lines `word [frequency]`; the highest frequency of a repeated word."""
    parts = read_list(spark, path).select(F.lower(F.split_part("value", F.lit(" "), F.lit(1))).alias("word"), F.expr("try_cast(nullif(split_part(value, ' ', 2), '') as double)").alias("zipf"))
    return parts.groupBy("word").agg(F.max("zipf").alias("zipf"))


_ANY = "struct<any:array<string>>"
_RULES = (
    "rules struct<direct_variants:array<struct<variants:map<string,string>>>,suffix_variants:array<struct<variants:map<string,string>,suffixes:array<string>>>,"
    f"context_variants:array<struct<variants:map<string,string>,apply_if:{_ANY},avoid_if:{_ANY},block_if:{_ANY},window:int>>,double_l_inflection:struct<bases:array<string>,suffixes:array<string>>>"
)


def read_spelling_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a JSON file as rows of `operators.spelling.RULES`; the bases that double their l are a variant each."""
    x = spark.read.schema(_RULES).option("multiLine", True).json(path).select("rules.*")
    none = F.array().cast("array<string>")
    words = lambda c: F.coalesce(c, none)

    def rows(kind: str, items: Column, variants: Callable[[Column], Column], **more: Callable[[Column], Column]) -> DataFrame:
        each = x.select(F.posexplode(items).alias("rank", "r"), "double_l_inflection")
        columns = [more[c](F.col("r")).alias(c) if c in more else none.alias(c) for c in ("suffixes", "apply_any", "avoid_any", "block_any")]
        near = F.coalesce(more["near"](F.col("r")), F.lit(6)) if "near" in more else F.lit(6)
        return each.select("rank", F.lit(kind).alias("kind"), variants(F.col("r")).alias("variants"), *columns, near.alias("near"))

    own = lambda r: r["variants"]
    listed = {f"{k}_any": lambda r, k=k: words(r[f"{k}_if"]["any"]) for k in ("apply", "avoid", "block")}
    out = rows("direct", F.col("direct_variants"), own).unionByName(rows("suffix", F.col("suffix_variants"), own, suffixes=lambda r: words(r["suffixes"])))
    out = out.unionByName(rows("context", F.col("context_variants"), own, near=lambda r: r["window"], **listed))
    return out.unionByName(rows("double", F.col("double_l_inflection.bases"), lambda r: F.create_map(F.lit("us"), r), suffixes=lambda r: words(F.col("double_l_inflection.suffixes"))))


def read_emoji(spark: SparkSession, path: str) -> DataFrame:
    """Emoji, replacement, description of a JSON object with an entry for each emoji."""
    entry = "map<string,struct<replacement:string,description:string>>"
    x = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", entry)).alias("emoji", "x"))
    return x.select("emoji", "x.replacement", "x.description")


def plain_name(name: str) -> str:
    """Letters and digits without accents."""
    t = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[a-z0-9]+", t))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Distinct names; single words of under three letters are none."""
    plain = F.pandas_udf(lambda s: s.map(plain_name), "string")
    return read_list(spark, path).select(plain("value").alias("name")).where((F.length("name") >= 3) | F.col("name").contains(" ")).distinct()


_GUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")


def save_profiles(profiles: DataFrame, path: str) -> None:
    """Rows with an id, stored by it."""
    profiles.write.mode("append").partitionBy("id").parquet(path)


def load_profile(spark: SparkSession, path: str, guid: str) -> DataFrame:
    if not _GUID.fullmatch(guid):
        raise ValueError("not a profile id")
    return spark.read.option("basePath", path).parquet(path).where(F.col("id") == guid)


def write_results(texts: DataFrame, deviations: DataFrame, path: str) -> None:
    """Rewritten texts, and what deviates, one JSON object a line."""
    texts.write.mode("overwrite").partitionBy("doc_id").text(f"{path}/texts")
    deviations.write.mode("overwrite").json(f"{path}/deviations")
