"""Scalar text functions as Column -> Column, all inside the JVM.

Patterns carry (?d): a line ends at a line feed only. Repetitions over long texts are possessive, so no text can
exhaust the matcher's stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from texmill.functions.folds import scan

# Tokens, environments, commands and thresholds that results depend on.
PLACEHOLDER = r"\[\[[A-Z_]+_\d+\]\]"
CHUNK_TOKEN = r"\{\{CHUNK_[a-f0-9-]+\}\}"
SOFT, PARAGRAPH = "[[SL]]", "[[PL]]"
SOFT_RAW, PARAGRAPH_RAW = "[[SL_RAW]]", "[[PL_RAW]]"
BLANKS = " \t\n\r\u000b\u000c"
SECTIONS = ("section", "subsection", "subsubsection", "paragraph", "subparagraph", "chapter", "part")
STRUCTURAL = (
    r"\\begin\{", r"\\end\{", r"\\section", r"\\subsection", r"\\subsubsection", r"\\paragraph", r"\\subparagraph", r"\\chapter", r"\\part",
    r"\\title", r"\\author", r"\\maketitle", r"\\bibliographystyle", r"\\bibliography", r"\\tableofcontents", r"\\listoffigures", r"\\listoftables", r"\\newpage", r"\\clearpage", r"\\balance",
    "%", r"\\item", r"\\caption", r"\\centering", r"\\label", r"\[(?!\[)", r"\](?!\])", r"\\toprule", r"\\midrule", r"\\bottomrule", r"\\hline", "&", r"\\\\\s*$",
)
#: What a chunk's length doesn't count, besides tokens: commands with their arguments, then braces, brackets and backslashes.
UNCOUNTED = (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^}]*\})*", r"[{}\[\]\\]")
COMMENT_SAFE = ("verbatim", "lstlisting", "minted", "comment")
ABSTRACT_LIMIT, CHUNK_LEAST = 2000, 20
CHARS_PER_TOKEN = {"http": 2.5, "ark": 2.5, "openai": 2.5, "anthropic": 3.5}


def strip(x: Column) -> Column:
    """Without white space at both ends (blanks, tabs, line ends), not blanks alone as trim does."""
    return F.btrim(x, F.lit(BLANKS))


def paper_id(x: Column) -> Column:
    """First modern id (dddd.dddd[d][vN]) in a string, else first old one (letters/ddddddd), else null."""
    modern, old = F.regexp_extract(x, r"\d{4}\.\d{4,5}(?:v\d+)?", 0), F.regexp_extract(x, r"[a-z-]+(?:\.[A-Z]{2})?/\d{7}", 0)
    return F.coalesce(F.nullif(modern, F.lit("")), F.nullif(old, F.lit("")))


def remove_comments(text: Column) -> Column:
    """Lines without their comments.

    Inside verbatim-like environments lines stay whole. Elsewhere `%!` lines stay, lines that begin with % go, others
    are cut at the first % without a backslash before it; a line that only then is blank goes; the rest lose blanks at
    their end. Any end of such an environment ends the verbatim state.
    """
    names = "|".join(COMMENT_SAFE)
    begins, ends = rf"\\begin\{{(?:{names})\}}", rf"\\end\{{(?:{names})\}}"

    def step(inside: Column, line: Column) -> tuple[Column, Column]:
        enters, leaves = line.rlike(begins), line.rlike(ends)
        whole = (inside | enters) & ~leaves
        first = F.ltrim(line)
        cut = F.regexp_replace(line, r"(?d)(?<!\\)%.*$", "")
        kept = (
            F.when(whole | first.startswith("%!"), F.array(line))
            .when(first.startswith("%"), F.slice(F.array(line), 1, 0))
            .when((strip(cut) == "") & (strip(line) != ""), F.slice(F.array(line), 1, 0))
            .otherwise(F.array(F.rtrim(cut)))
        )
        return F.when(leaves, False).otherwise(inside | enters), kept

    return F.array_join(scan(F.split(text, "\n", -1), F.lit(False), step, "string"), "\n")


def split_document(text: Column) -> Column:
    """struct(preamble, body), cut behind the first begin-document; without one the preamble is empty."""
    mark = "\\begin{document}"
    at = F.instr(text, mark)
    cut = at + len(mark) - 1
    return F.struct(F.when(at > 0, F.substr(text, F.lit(1), cut)).otherwise(F.lit("")).alias("preamble"), F.when(at > 0, F.substr(text, cut + 1)).otherwise(text).alias("body"))


def abstract(text: Column) -> Column:
    """The first abstract without comment lines, trimmed, over 2000 characters cut with dots; null if there is none."""
    inner = F.regexp_extract(text, r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", 1)
    lines = F.filter(F.split(inner, "\n", -1), lambda x: ~F.ltrim(x).startswith("%"))
    said = strip(F.array_join(lines, "\n"))
    short = F.when(F.length(said) > ABSTRACT_LIMIT, F.concat(F.left(said, F.lit(ABSTRACT_LIMIT)), F.lit("..."))).otherwise(said)
    return F.nullif(short, F.lit(""))


def inject_cjk(text: Column, main: str = "Noto Serif CJK SC", sans: str = "Noto Sans CJK SC", mono: str = "Noto Sans Mono CJK SC") -> Column:
    """Packages and fonts for CJK behind the document class, or before the document, or at the end; once only."""
    fonts = f"\n% CJK support\n\\usepackage{{xeCJK}}\n\\setCJKmainfont{{{main}}}\n\\setCJKsansfont{{{sans}}}\n\\setCJKmonofont{{{mono}}}\n"
    bare = F.regexp_replace(text, r"\\usepackage\s*\[(?:T1\]\s*\{fontenc|utf8\]\s*\{inputenc)\}\s*\n?", "")
    classed, begun = r"\\documentclass\s*(?:\[[^\]]*\])?\s*\{[^}]+\}\s*\n?", "\\begin{document}"
    first = F.regexp_instr(bare, F.lit(classed))
    cut = first + F.length(F.regexp_extract(bare, classed, 0)) - 1
    at = F.instr(bare, begun)
    put = F.when(first > 0, F.concat(F.left(bare, cut), F.lit(fonts), F.substr(bare, cut + 1)))
    put = put.when(at > 0, F.concat(F.left(bare, at - 1), F.lit(fonts + "\n"), F.substr(bare, at))).otherwise(F.concat(bare, F.lit("\n" + fonts)))
    return F.when(F.contains(text, F.lit("xeCJK")), text).otherwise(put)


def escape_specials(text: Column) -> Column:
    """%, & and # get a backslash unless they have one, outside placeholders and chunk tokens."""
    token = rf"\[\[.*?\]\]|{CHUNK_TOKEN}"
    between = F.transform(F.split(text, token, -1), lambda x: F.regexp_replace(x, r"(?<!\\)([%&#])", r"\\$1"))
    tokens = F.concat(F.regexp_extract_all(text, F.lit(token), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, tokens, lambda a, b: F.concat(a, b)), "")


def unify_line_ends(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def encode_line_ends(text: Column) -> Column:
    """Line ends as tokens: two in a row a paragraph token, one a soft token; such tokens in the text as raw tokens."""
    x = unify_line_ends(text)
    for token, raw, guard in ((SOFT, SOFT_RAW, "[[SL_RAW_RAW]]"), (PARAGRAPH, PARAGRAPH_RAW, "[[PL_RAW_RAW]]")):
        x = F.replace(F.replace(x, F.lit(raw), F.lit(guard)), F.lit(token), F.lit(raw))
    return F.replace(F.replace(x, F.lit("\n\n"), F.lit(PARAGRAPH)), F.lit("\n"), F.lit(SOFT))


def decode_line_ends(text: Column) -> Column:
    x = F.replace(F.replace(text, F.lit(PARAGRAPH), F.lit("\n\n")), F.lit(SOFT), F.lit("\n"))
    for token, raw, guard in ((PARAGRAPH, PARAGRAPH_RAW, "[[PL_RAW_RAW]]"), (SOFT, SOFT_RAW, "[[SL_RAW_RAW]]")):
        x = F.replace(F.replace(x, F.lit(raw), F.lit(token)), F.lit(guard), F.lit(raw))
    return x


def line_break_counts(text: Column) -> Column:
    """struct(soft, paragraph): pairs of line ends from the left count as paragraphs, the rest as soft breaks."""
    x = unify_line_ends(text)
    pairs = ((F.length(x) - F.length(F.replace(x, F.lit("\n\n"), F.lit("")))) / 2).cast("long")
    single = F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    return F.struct((single - 2 * pairs).cast("long").alias("soft"), pairs.alias("paragraph"))


def only_placeholder(text: Column) -> Column:
    return text.rlike(rf"^\s*+{PLACEHOLDER}\s*+$")


def structural_line(line: Column) -> Column:
    return strip(line).rlike("^(?:" + "|".join(STRUCTURAL) + ")")


def clean_length(text: Column) -> Column:
    """Length without tokens, commands with their arguments, braces, brackets and backslashes."""
    for pattern in (PLACEHOLDER, CHUNK_TOKEN, *UNCOUNTED):
        text = F.regexp_replace(text, pattern, "")
    return F.length(strip(text)).cast("long")


def token_estimate(text: Column, provider: str = "openai") -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN[provider]).cast("long")


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens by a tokenizer file (.json of the tokenizers library), where the estimate isn't enough; null for null."""
    held: dict = {}

    @F.pandas_udf("long")
    def count(texts):
        from tokenizers import Tokenizer

        if not held:
            held["t"] = Tokenizer.from_file(tokenizer)
        of = held["t"].encode_batch([t or "" for t in texts], add_special_tokens=False)
        return texts.__class__([None if t is None else len(e.ids) for t, e in zip(texts, of, strict=True)], dtype="Int64")

    return count(text)


def line_and_column(text: Column, offset: Column) -> Column:
    """1-based line and column of a 0-based offset."""
    before = F.left(text, offset)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    column = F.length(F.substring_index(before, "\n", -1)) + 1
    return F.struct(line.cast("long").alias("line"), column.cast("long").alias("col"))


def snippet(text: Column, offset: Column, around: int = 30) -> Column:
    """The offset's line, at most `around` characters either side, and a caret under the place."""
    before, after = F.substring_index(F.left(text, offset), "\n", -1), F.substring_index(F.substr(text, offset + 1), "\n", 1)
    left = F.right(before, F.lit(around))
    return F.concat(left, F.left(after, F.lit(around)), F.lit("\n"), F.repeat(F.lit(" "), F.length(left)), F.lit("^"))


def endpoint(url: Column) -> Column:
    """An endpoint without route suffixes and end slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"/+$", ""), r"(?:/v1)?/(?:chat/completions|completions|messages|responses)$", "")


def safe_int(x: Column) -> Column:
    return F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))


def short_error(x: Column, most: int = 240) -> Column:
    return F.left(F.regexp_replace(strip(x), r"\s+", " "), F.lit(most))


def member_class(path: Column) -> Column:
    """Class of an archive member by its extension."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return (
        F.when(ext == ".tex", "tex")
        .when(ext == ".bib", "bib")
        .when(ext.isin(".png", ".jpg", ".jpeg", ".pdf", ".eps", ".ps"), "image")
        .when(ext.isin(".sty", ".cls", ".bst"), "style")
        .otherwise("other")
    )


def first_tex_error(log: Column) -> Column:
    """The first line that begins with ! and four more; else the line of a fatal error; else null."""
    found = F.regexp_extract(log, r"(?dm)^[ \t]*(!.*(?:\n.*){0,4})", 1)
    fatal = F.regexp_extract(log, r"(?dm)^(.*Fatal error.*)$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(fatal, F.lit("")))


def bibliography_tool(text: Column) -> Column:
    return F.when(text.rlike(r"\\usepackage(?:\[[^\]]*\])?\{biblatex\}|\\addbibresource"), "biber").when(text.rlike(r"\\bibliography\{"), "bibtex")


def config_value(x: Column) -> Column:
    """struct(kind, value) of a command-line value: bool, int, float or string."""
    low = F.lower(x)
    kind = F.when(low.isin("true", "false"), "bool").when(x.rlike(r"^[+-]?\d+$"), "int").when(x.try_cast("double").isNotNull() & x.rlike(r"\d"), "float").otherwise("string")
    return F.struct(kind.alias("kind"), F.when(low.isin("true", "false"), low).otherwise(x).alias("value"))


def archive_kind(content: Column) -> Column:
    """gz by magic bytes, tar by its mark, tex by its first characters, else unknown."""
    head = F.decode(F.substring(content, 1, 10), "ISO-8859-1")
    return (
        F.when(F.hex(F.substring(content, 1, 2)) == "1F8B", "gz")
        .when(F.decode(F.substring(content, 258, 5), "ISO-8859-1") == "ustar", "tar")
        .when(F.contains(head, F.lit("\\docum")) | F.contains(head, F.lit("%")), "tex")
        .otherwise("unknown")
    )
