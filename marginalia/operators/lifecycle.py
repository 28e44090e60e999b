"""Changes to notes as functions of their content: fields, paragraphs, links."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import link_key, stem
from ..sources.notes import parse_text


def quote(value: str) -> str:
    """A header value, quoted where it would otherwise be read as something else."""
    plain = ":" not in value and not value.startswith(("[", "#"))
    return value if plain or value.startswith("[[") else '"' + value.replace('"', "'") + '"'


def set_field(content: str, key: str, value: str) -> str:
    """The content with the field set: the first line of the key is replaced, or a line is added. A note without a
    header stays as it is."""
    if not content.startswith("---\n") or (end := content.find("\n---", 3)) < 0:
        return content
    head, tail = content[4 : max(end, 4)], content[end:]
    lines = head.split("\n") if head else []
    line = f"{key}: {quote(value)}"
    at = next((i for i, x in enumerate(lines) if x.startswith(f"{key}:")), None)
    lines = [*lines, line] if at is None else [*lines[:at], line, *lines[at + 1 :]]
    return "---\n" + "\n".join(lines) + tail


def remove_field(content: str, key: str) -> str:
    if not content.startswith("---\n") or (end := content.find("\n---", 3)) < 0:
        return content
    lines = content[4 : max(end, 4)].split("\n")
    at = next((i for i, x in enumerate(lines) if x.startswith(f"{key}:")), None)
    return content if at is None else "---\n" + "\n".join(lines[:at] + lines[at + 1 :]) + content[end:]


def append_paragraph(content, paragraph):
    """Columns or literals: the content, a blank line, the trimmed paragraph, one line end."""
    return F.concat(F.regexp_replace(content, r"\n+$", ""), F.lit("\n\n"), F.regexp_replace(paragraph, r"(?U)^\s+|\s+$", ""), F.lit("\n"))


def key_of(name: str) -> str:
    return "".join(c for c in name if c.isalnum()).lower()


def relink_text(content: str, old_key: str, new: str) -> tuple[str, int]:
    """Links to the old key lead to the new name; aliases and sections stay. And how many there were. A link that isn't
    closed ends the search."""
    n = 0

    def swap(m: re.Match) -> str:
        nonlocal n
        inside = m[1]
        cut = min((i for i in (inside.find("|"), inside.find("#")) if i >= 0), default=len(inside))
        if key_of(inside[:cut]) != old_key:
            return m[0]
        n += 1
        return f"[[{new}{inside[cut:]}]]"

    return re.sub(r"\[\[(.*?)\]\]", swap, content, flags=re.S), n


def relink(notes: DataFrame, old_key: str, new: str, column: str = "content") -> DataFrame:
    """The notes with ``column`` relinked and ``relinked``, the number of links changed. Notes without the key are not
    sent to Python."""
    @F.pandas_udf("text string, n int")
    def swap(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([relink_text(x, old_key, new) if x is not None else (None, 0) for x in texts], columns=["text", "n"])

    has = F.contains(link_key(F.col(column)), F.lit(old_key))
    some = notes.where(has).withColumn("r", swap(column)).withColumn(column, F.col("r.text")).withColumn("relinked", F.col("r.n")).drop("r")
    return some.unionByName(notes.where(~F.coalesce(has, F.lit(False))).withColumn("relinked", F.lit(0)))


def supersede(notes: DataFrame, old_path: str, new_path: str, new_content: str, today: str) -> DataFrame:
    """``notes(path, content)`` with a new note, the old one archived and pointing to it, and all links to the old one's
    name and stem led to the new."""
    old = [r["content"] for r in notes.where(F.col("path") == old_path).select("content").limit(2).collect()]
    if not old:
        raise ValueError(f"no note {old_path}")
    new_name = new_path.rsplit("/", 1)[-1].removesuffix(".md")
    fields, _ = parse_text(old[0])
    keys = {key_of(old_path.rsplit("/", 1)[-1].removesuffix(".md")), key_of(fields.get("name", ""))} - {""}
    archived = set_field(set_field(set_field(old[0], "status", "archived"), "superseded_by", f"[[{new_name}]]"), "verified", today)
    rest = notes.where(F.col("path") != old_path).select("path", "content")
    for key in sorted(keys):
        rest = relink(rest, key, new_name).drop("relinked")
    two = notes.sparkSession.createDataFrame([(old_path, archived), (new_path, new_content)], "path string, content string")
    return rest.unionByName(two)


def see_also(content: str, name: str) -> str:
    """The content with a link to the name, unless it has one."""
    if any(key_of(re.split(r"[|#]", x)[0]) == key_of(name) for x in re.findall(r"\[\[([^\[\]]*)\]\]", content)):
        return content
    return content.rstrip("\n") + f"\n\nSee also [[{name}]]\n"


def link_both(notes: DataFrame, a: str, b: str) -> DataFrame:
    """``notes(path, content)`` where the notes at the paths a and b link to each other."""
    name = lambda p: p.rsplit("/", 1)[-1].removesuffix(".md")
    other = {a: name(b), b: name(a)}

    @F.pandas_udf("string")
    def add(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([see_also(t, other[p]) if p in other and t is not None else t for p, t in zip(paths, texts)])

    return notes.withColumn("content", F.when(F.col("path").isin(a, b), add("path", "content")).otherwise(F.col("content")))


def find_note(notes: DataFrame, name: str, project: str | None = None) -> str:
    """The one path whose stem has the name's key, within a project if one is given; an error if there is none or more."""
    rows = notes.where(link_key(stem(F.col("path"))) == key_of(name))
    if project:
        rows = rows.where(F.startswith("path", F.lit(project + "/")))
    found = [r["path"] for r in rows.select("path").distinct().orderBy("path").limit(10).collect()]
    if len(found) != 1:
        raise LookupError(f"{name}: {'not found' if not found else 'ambiguous: ' + ', '.join(found)}")
    return found[0]


def new_note(name: str, description: str, type_: str, body: str, today: str) -> str:
    """The text of a new note; ``verified`` is today."""
    head = {"name": name, "description": description, "type": type_, "status": "active", "verified": today}
    return "---\n" + "".join(f"{k}: {quote(v)}\n" for k, v in head.items()) + "---\n\n" + body.strip() + "\n"
