"""LaTeX documents to protected templates, chunks and placeholders.

Each pass rewrites the text that the next one reads, so a document is one unit of work: `parse` runs the passes over
a batch of documents inside mapInPandas, and its rows (kind: template, chunk or placeholder) are then plain tables.
A pass finds spans, from the left and not inside each other, and `rewrite` puts something in their place. Chunk ids
are hashes of document, context, number and content, so a second parse gives the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texmill.functions import text as fn

# Environments and commands by how they are treated.
PROTECTED = (
    "algorithm algorithm2e algorithmic align align* eqnarray eqnarray* equation equation* gather gather* lstlisting minted multline multline* split table table* tikzpicture verbatim"
).split()
TRANSLATABLE = "abstract description enumerate itemize".split()
UNSCANNED = "lstlisting minted verbatim".split()
COMMAND_KINDS = (("cite", "CITE"), ("ref", "REF"), ("eqref", "REF"), ("label", "LABEL"), ("url", "URL"), ("href", "HREF"))
_STRUCTURAL = re.compile("(?:" + "|".join(fn.STRUCTURAL) + ")")
_ONLY = re.compile(rf"\s*{fn.PLACEHOLDER}\s*")
_CHUNK = re.compile(fn.CHUNK_TOKEN)

Span = tuple[int, int, str]
SCHEMA = "doc_id string, kind string, ord int, id string, context string, wrapper string, content string"


def closing(text: str, at: int, opener: str = "{", closer: str = "}", escapes: bool = False) -> int | None:
    """Index behind the closer of the group that opens at `at`, or None; escapes: a backslash hides the next sign."""
    depth = 0
    for m in re.compile(rf"\\.|[{re.escape(opener + closer)}]" if escapes else f"[{re.escape(opener + closer)}]", re.S).finditer(text, at):
        if len(m[0]) == 1:
            depth += 1 if m[0] == opener else -1
            if depth == 0:
                return m.end()
    return None


def environment_end(text: str, name: str, at: int) -> tuple[int, int] | None:
    """Where the end of an environment that is open at `at` begins and ends; equal names may nest."""
    depth = 1
    for m in re.compile(rf"\\(begin|end)\{{{re.escape(name)}\}}").finditer(text, at):
        depth += 1 if m[1] == "begin" else -1
        if not depth:
            return m.start(), m.end()
    return None


@dataclass
class Parsed:
    """What the passes have made of a document so far."""

    doc_id: str
    chunks: list[dict] = field(default_factory=list)
    placeholders: list[tuple[str, str]] = field(default_factory=list)

    def protect(self, kind: str, original: str) -> str:
        token = f"[[{kind}_{len(self.placeholders) + 1}]]"
        self.placeholders.append((token, original))
        return token

    def chunk(self, content: str, context: str, wrapper: str = "%s") -> str:
        raw = "|".join((self.doc_id, context, str(len(self.chunks)), content))
        made = hashlib.sha256(raw.encode()).hexdigest()[:32]
        self.chunks.append({"id": made, "content": content, "context": context, "wrapper": wrapper})
        return f"{{{{CHUNK_{made}}}}}"


def rewrite(text: str, spans: Iterator[Span]) -> str:
    out, at = [], 0
    for first, stop, new in spans:
        out += [text[at:first], new]
        at = stop
    return "".join([*out, text[at:]])


def outermost(text: str, pattern: re.Pattern, find: Callable[[re.Match], tuple[int, str] | None]) -> Iterator[Span]:
    """Spans of matches that `find` accepts with (stop, new text), skipping what lies inside one before."""
    at = 0
    while m := pattern.search(text, at):
        made = find(m)
        at = m.end() if made is None else made[0]
        if made is not None:
            yield m.start(), made[0], made[1]


def taken(content: str) -> bool:
    """Blank, or already begun by a token: stays as it is."""
    return not content.strip() or content.lstrip().startswith("[[") or bool(_CHUNK.match(content.strip()))


def title(doc: Parsed, text: str) -> str:
    def find(m: re.Match):
        if (stop := closing(text, m.end() - 1)) is None or taken(text[m.end() : stop - 1]):
            return None
        return stop, m[0] + doc.chunk(text[m.end() : stop - 1].strip(), "title") + "}"

    return rewrite(text, outermost(text, re.compile(r"\\title\*?\s*\{"), find))


def author(doc: Parsed, text: str) -> str:
    def find(m: re.Match):
        stop = closing(text, m.end() - 1)
        return None if stop is None else (stop, doc.protect("AUTHOR", text[m.start() : stop]))

    return rewrite(text, outermost(text, re.compile(r"\\author\s*(?:\[[^\]]*\])?\s*\{"), find))


def captions(doc: Parsed, text: str) -> str:
    hidden = []
    for m in re.finditer(rf"\\begin\{{({'|'.join(UNSCANNED)})\}}", text):
        end = environment_end(text, m[1], m.end())
        hidden.append((m.start(), end[1] if end else len(text)))

    def find(m: re.Match):
        if any(a <= m.start() < b for a, b in hidden):
            return None
        at = m.end()
        if m[1]:  # captionof names its kind first
            kind = re.compile(r"\s*\{").match(text, at)
            at = closing(text, kind.end() - 1, escapes=True) if kind else None
        if at is not None and (short := re.compile(r"\s*\[").match(text, at)):
            at = closing(text, short.end() - 1, "[", "]", escapes=True)
        brace = re.compile(r"\s*\{").match(text, at) if at is not None else None
        stop = closing(text, brace.end() - 1, escapes=True) if brace else None
        if stop is None or taken(text[brace.end() : stop - 1]):
            return None
        return stop, text[m.start() : brace.end()] + doc.chunk(text[brace.end() : stop - 1].strip(), "caption") + "}"

    return rewrite(text, outermost(text, re.compile(r"\\caption(of)?(?![A-Za-z])\*?"), find))


def protected_environments(doc: Parsed, text: str, extra: tuple[str, ...] = ()) -> str:
    for name in sorted({*PROTECTED, *extra}):
        begin = re.compile(rf"\\begin\{{{re.escape(name)}\}}")

        def find(m: re.Match, text=text, name=name):
            end = environment_end(text, name, m.end())
            return (end[1], doc.protect("ENV", text[m.start() : end[1]])) if end else None

        text = rewrite(text, outermost(text, begin, find))
    return text


_MATH = re.compile(r"\\\$|(\$\$(?:\\\$|(?!\$\$).)*+(?:\$\$|\Z)|\$(?:\\\$|[^$])*+(?:\$|\Z))", re.S)


def inline_math(doc: Parsed, text: str) -> str:
    """Dollar math; an open one runs to the end; what holds an empty line stays."""
    return _MATH.sub(lambda m: m[0] if not m[1] or "\n\n" in m[1] else doc.protect("MATH", m[1]), text)


def display_math(doc: Parsed, text: str, strict: bool = True) -> str:
    """\\[..\\] and then \\(..\\); strict: the bracket of a line break with a length opens none."""
    guard = r"(?<!\\)" if strict else ""
    for pattern in (rf"{guard}\\\[.*?\\\]", rf"{guard}\\\(.*?\\\)"):
        text = re.sub(pattern, lambda m: doc.protect("MATH", m[0]), text, flags=re.S)
    return text


def commands(doc: Parsed, text: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    patterns = [(rf"\\{name}\s*\{{", kind) for name, kind in (*COMMAND_KINDS, *extra)]
    for pattern, kind in [*patterns, (r"\\includegraphics(?:\[[^\]]*\])?\s*\{", "GRAPHICS")]:

        def find(m: re.Match, text=text, kind=kind):
            stop = closing(text, m.end() - 1)
            return None if stop is None else (stop, doc.protect(kind, text[m.start() : stop]))

        text = rewrite(text, outermost(text, re.compile(pattern), find))
    return text


def sections(doc: Parsed, text: str) -> str:
    for name in fn.SECTIONS:

        def find(m: re.Match, text=text, name=name):
            if (stop := closing(text, m.end() - 1)) is None:
                return None
            content = text[m.end() : stop - 1]
            inner = content if not content.strip() or content.startswith("[[") else doc.chunk(content, name)
            rest = text[stop:].split("\n", 1)[0]
            return stop, m[0] + inner + "}" + ("\n" if rest.strip() else "")

        text = rewrite(text, outermost(text, re.compile(rf"\\{name}\*?\s*\{{"), find))
    return text


def translatable_environments(doc: Parsed, text: str) -> str:
    for name in TRANSLATABLE:
        begin = re.compile(rf"\\begin\{{{name}\}}")

        def find(m: re.Match, text=text, name=name):
            end = environment_end(text, name, m.end())
            if not end or taken(text[m.end() : end[0]]):
                return None
            token = doc.chunk(text[m.end() : end[0]].strip(), name)
            return end[1], f"\\begin{{{name}}}\n{token}\n\\end{{{name}}}"

        text = rewrite(text, outermost(text, begin, find))
    return text


def footnotes(doc: Parsed, text: str) -> str:
    def find(m: re.Match):
        if (stop := closing(text, m.end() - 1, escapes=True)) is None or taken(text[m.end() : stop - 1]):
            return None
        return stop, doc.chunk(text[m.end() : stop - 1].strip(), "footnote", f"{m[0]}%s}}")

    return rewrite(text, outermost(text, re.compile(r"\\footnote(?:text)?(?:\[[^\]]*\])?\s*\{"), find))


def clean_length(text: str) -> int:
    """What fn.clean_length gives, for a pass that is under way."""
    for pattern in (fn.PLACEHOLDER, fn.CHUNK_TOKEN, *fn.UNCOUNTED):
        text = re.sub(pattern, "", text)
    return len(text.strip())


def paragraphs(doc: Parsed, text: str) -> str:
    """Runs of lines that are neither blank nor structural become chunks if they say enough."""
    out, run = [], []

    def end() -> None:
        if run:
            whole = "\n".join(run)
            keep = _ONLY.fullmatch(whole) or clean_length(whole) < fn.CHUNK_LEAST
            out.append(whole if keep else doc.chunk(whole.strip(), "paragraph"))
            run.clear()

    for line in text.split("\n"):
        said = line.strip()
        if said and not _STRUCTURAL.match(said):
            run.append(line)
        else:
            end()
            out.append(line)
    end()
    return "\n".join(out)


def parse_text(doc_id: str, preamble: str, body: str, extra_environments: tuple[str, ...] = (), strict: bool = True) -> tuple[Parsed, str, str]:
    doc = Parsed(doc_id)
    preamble = title(doc, preamble)
    for step in (title, author, captions):
        body = step(doc, body)
    body = protected_environments(doc, body, extra_environments)
    body = inline_math(doc, body)
    body = display_math(doc, body, strict)
    for step in (commands, sections, translatable_environments):
        body = step(doc, body)
    noted = Parsed(doc_id, [], doc.placeholders)
    noted.chunk = doc.chunk
    body = footnotes(noted, body)
    return doc, preamble, paragraphs(doc, body)


def parse(docs: DataFrame, extra_environments: tuple[str, ...] = (), strict: bool = True, key: str = "doc_id", column: str = "tex") -> DataFrame:
    """Rows (doc_id, kind, ord, id, context, wrapper, content) of every document.

    Comments go first, in the JVM. kind is template (preamble with ord 0, body with ord 1), chunk, or placeholder
    (id is the token, content the original, context its kind).
    """
    clean = fn.remove_comments(fn.unify_line_ends(F.col(column)))
    parts = fn.split_document(F.col("clean"))
    source = docs.select(F.col(key).cast("string").alias("doc_id"), clean.alias("clean")).select("doc_id", parts["preamble"].alias("preamble"), parts["body"].alias("body"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            rows = []
            for d in frame.itertuples():
                if d.body is None:
                    continue
                doc, preamble, body = parse_text(d.doc_id, d.preamble, d.body, extra_environments, strict)
                rows += [(d.doc_id, "template", k, None, None, None, t) for k, t in enumerate((preamble, body))]
                rows += [(d.doc_id, "chunk", k, c["id"], c["context"], c["wrapper"], c["content"]) for k, c in enumerate(doc.chunks)]
                rows += [(d.doc_id, "placeholder", k, t, t[2:].rpartition("_")[0], None, o) for k, (t, o) in enumerate(doc.placeholders)]
            yield pd.DataFrame(rows, columns=names)

    return source.mapInPandas(run, SCHEMA)


def chunk_references(parsed: DataFrame) -> DataFrame:
    """doc_id, chunk_id of every chunk token in a template, chunk or placeholder."""
    ids = F.regexp_extract_all("content", F.lit(r"\{\{CHUNK_([a-f0-9-]+)\}\}"), F.lit(1))
    return parsed.select("doc_id", F.explode(ids).alias("chunk_id")).distinct()
