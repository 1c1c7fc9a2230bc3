"""Page text and cleaning."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from .ranking import half_up


#: What a character reference stands for: every name of HTML 5, and the numbers that don't stand for their own character.
REFERENCES = html5 | {f"#{n}": html.unescape(f"&#{n};") for n in range(160)}
#: Names that need no semicolon, longest first.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def _character(n: Column) -> Column:
    """The character of a code point: U+FFFD for surrogates and beyond the last, nothing for those that aren't characters."""
    wide = n - 0x10000
    units = F.when(n < 0x10000, F.lpad(F.hex(n), 4, "0")).otherwise(
        F.concat(F.hex(F.shiftright(wide, 10) + 0xD800), F.hex(wide.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
    )
    return (
        F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "�")
        .when(n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE), "")
        .otherwise(F.decode(F.unhex(units), "UTF-16BE"))
    )


def unescape(text: Column, table: list[tuple[str, str]] | None = None) -> Column:
    """HTML character references as HTML 5 reads them: by number, by name, or by the longest name that needs no semicolon.

    One pass: what a reference gives isn't read again. Texts without an ampersand aren't taken apart.

    table: (reference, character) replaced as they stand, in this order, and no others.
    """
    if table is not None:
        for reference, character in table:
            text = F.replace(text, F.lit(reference), F.lit(character))
        return text
    known = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in REFERENCES.items())), F.lit("\x01"), F.lit("\x02"))

    def piece(p: Column) -> Column:
        rest = lambda token: F.substr(p, F.length(token) + 1)
        number = F.regexp_extract(p, "^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", 0)
        hexa = F.regexp_extract(number, "^#[xX]0*([0-9a-fA-F]*)", 1)
        digits = F.regexp_extract(number, "^#0*([0-9]*)", 1)
        value = F.when(number.rlike("^#[xX]"), F.when(F.length(hexa) > 6, 0x110000).otherwise(F.conv(F.concat(F.lit("0"), hexa), 16, 10).cast("int")))
        value = value.otherwise(F.when(F.length(digits) > 7, 0x110000).otherwise(F.concat(F.lit("0"), digits).cast("int")))
        char = F.when(value < 160, F.element_at(known, F.concat(F.lit("#"), value.cast("string")))).otherwise(_character(value))
        name, bare = F.regexp_extract(p, r"^[^\t\n\f <&#;]{1,32};?", 0), F.regexp_extract(p, f"^(?:{_BARE})", 0)
        named = F.coalesce(*(F.concat(F.element_at(known, t), rest(t)) for t in (name, bare)), F.concat(F.lit("&"), p))
        return F.when(number != "", F.concat(char, rest(number))).otherwise(named)

    pieces = F.split(text, "&")
    whole = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), piece), ""))
    return F.when(text.contains("&"), whole).otherwise(text)


def main_text(html: Column, table: list[tuple[str, str]] | None = None) -> Column:
    """B11, in built-in functions: dropped elements out, then the block texts of the article (else main, else body) by
    blank lines. Needs 100 characters in a container to choose it. table: as unescape's."""
    page = F.coalesce(html, F.lit(""))
    for tag in R.DROPPED_ELEMENTS:
        page = F.regexp_replace(page, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    page = F.regexp_replace(page, "(?s)<!--.*?-->", " ")
    classes = "|".join(R.DROPPED_CLASSES)
    page = F.regexp_replace(page, rf'(?is)<(div|section|aside|ul)\b[^>]*class="(?:[^"]* )?(?:{classes})(?: [^"]*)?"[^>]*>.*?</\1>', " ")

    def blocks(part: Column) -> Column:
        found = F.regexp_extract_all(part, F.lit(r"(?is)<(p|h[1-6]|li|blockquote)\b[^>]*>(.*?)</\1>"), F.lit(2))
        plain = F.transform(found, lambda b: F.trim(F.regexp_replace(unescape(F.regexp_replace(b, "<[^>]*>", " "), table), r"\s+", " ")))
        return F.array_join(F.filter(plain, lambda b: b != ""), "\n\n")

    choices = [blocks(F.regexp_extract(page, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)) for tag in ("article", "main")]
    return F.coalesce(*(F.when(F.length(c) >= R.MIN_CONTENT, c) for c in choices), blocks(page))


def extract_main_text(pages: DataFrame, html: str = "html", table: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pages plus main_text."""
    return pages.withColumn("main_text", main_text(F.col(html), table))


class _Blocks(HTMLParser):
    """Block texts of a page outside dropped elements, with the selectors that hold each."""

    VOID = {"br", "img", "hr", "meta", "link", "input", "source", "area", "base", "col", "embed", "wbr", "track"}
    BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, set[str], bool]] = []
        self.found: list[tuple[set[str], str]] = []
        self.text: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        a = dict(attrs)
        names = set((a.get("class") or "").split())
        marks = {tag} | {f".{c}" for c in names}
        marks |= {f'[{k}="{v}"]' for k, v in a.items() if k in ("role", "itemprop")} | {f"#{a.get('id')}"}
        dropped = tag in R.DROPPED_ELEMENTS or bool(names & set(R.DROPPED_CLASSES)) or any(d for *_, d in self.stack)
        self.stack.append((tag, marks, dropped))
        if tag in self.BLOCK and self.text is None and not dropped:
            self.text = []

    def handle_endtag(self, tag):
        if not any(t == tag for t, *_ in self.stack):
            return
        while self.stack:
            last, _, dropped = self.stack.pop()
            if last in self.BLOCK and self.text is not None and not dropped:
                text = " ".join("".join(self.text).split())
                if text:
                    self.found.append((set().union(*(m for _, m, _ in self.stack)), text))
                self.text = None
            if last == tag:
                break

    def handle_data(self, data):
        if self.text is not None and not any(d for *_, d in self.stack):
            self.text.append(data)

    def main(self) -> str:
        for selector in R.CONTENT_SELECTORS:
            text = "\n\n".join(t for marks, t in self.found if selector in marks)
            if len(text) >= R.MIN_CONTENT:
                return text
        return "\n\n".join(t for _, t in self.found)


def parse_main_text(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """B11, with the full list of selectors: page id and main_text by a streaming HTML parser, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for page in f[html]:
                p = _Blocks()
                p.feed(page or "")
                p.close()
                out.append(p.main())
            yield pd.DataFrame({page_id: f[page_id], "main_text": out})

    return pages.select(page_id, html).mapInPandas(run, f"{page_id} long, main_text string")


def choose_content(df: DataFrame) -> DataFrame:
    """main_text of 100 characters or more, else the feed's description; with success and error."""
    long = F.length(F.coalesce("main_text", F.lit(""))) >= R.MIN_CONTENT
    return df.withColumns(
        {
            "content": F.when(long, F.col("main_text")).otherwise(F.coalesce("description", F.lit(""))),
            "success": long,
            "error": F.when(~long, F.lit("content too short, description used")),
        }
    )


def remove_urls(text: Column) -> Column:
    """URLs out; the domain after words like "malicious domain" stays."""
    kept = r"(?i)\b((?:malicious|phishing|c2|command.?and.?control|malware|apt))\s+(?:domain|site|server)s?\s*:?\s*([a-zA-Z0-9][a-zA-Z0-9-]{0,61}[a-zA-Z0-9]?\.[a-zA-Z]{2,})"
    text = F.regexp_replace(text, kept, "$1 $2")
    for p in (r"https?://\S+", r"www\.\S+", r"\[http[^\]]+\]"):
        text = F.regexp_replace(text, p, "")
    return text


def strip_markup(text: Column, table: list[tuple[str, str]] | None = None) -> Column:
    return F.regexp_replace(unescape(text, table), "<[^>]+>", " ")


def remove_navigation(text: Column) -> Column:
    """Navigation words out, then lines of up to three words that hold one."""
    text = F.regexp_replace(text, "(?i)" + "|".join(R.NAVIGATION), " ")
    words = lambda line: F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    nav = F.array(*map(F.lit, R.NAVIGATION_WORDS))
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~((F.size(words(x)) <= 3) & F.arrays_overlap(words(x), nav))), "\n")


#: What a text with a footer has: the beginning of each footer phrase, or an inner word of it.
_FOOTER_SIGNS = r"(?i)appeared first on|source|originally|copyright|all rights|full article|©|filed under|tagged with|minute read|reading time"


def remove_bylines(text: Column) -> Column:
    """Bylines out unless the beginning speaks of a threat."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?m)^By\s+.+?\n", ""), r"(?im)^Author:?\s*.+?\n", "")
    return F.when(F.substring(text, 1, 200).rlike("(?i)(CVE|vulnerability|exploit|malware)"), text).otherwise(plain)


def squeeze(text: Column) -> Column:
    """One blank for a run of blanks, trimmed lines, no empty lines."""
    text = F.regexp_replace(F.regexp_replace(text, r"[\t\r\f\x0B]+", " "), " {2,}", " ")
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def clean_text(df: DataFrame, text: str = "content", table: list[tuple[str, str]] | None = None) -> DataFrame:
    """Df plus cleaned; the order of the chain is part of its meaning. Each step is a column of its own, so none runs twice.
    table: as unescape's."""
    step = F.col("__c")
    rows = df.withColumn("__c", remove_urls(strip_markup(F.coalesce(text, F.lit("")), table)))
    rows = rows.withColumn("__c", remove_navigation(step))
    rows = rows.withColumn("__c", F.when(step.rlike(_FOOTER_SIGNS), F.regexp_replace(step, "(?i)" + "|".join(R.FOOTERS), "")).otherwise(step))
    rows = rows.withColumn("__c", remove_bylines(step))
    rows = rows.withColumn("__c", squeeze(step))
    cut = F.when(F.length(step) > R.MAX_CONTENT, F.concat(F.substring(step, 1, R.MAX_CONTENT), F.lit("..."))).otherwise(step)
    return rows.withColumn("cleaned", cut).drop("__c")


def cleaning_metrics(df: DataFrame, text: str = "content") -> DataFrame:
    """Original and cleaned length, characters removed, percent (0 of an empty text, 2 decimals)."""
    before, after = F.length(F.coalesce(text, F.lit(""))), F.length("cleaned")
    return df.withColumns(
        {
            "original_length": before,
            "cleaned_length": after,
            "chars_removed": before - after,
            "reduction_percent": F.when(before > 0, half_up((before - after) / before * 100, 2)).otherwise(0.0),
        }
    )


def clean_title(title: Column, table: list[tuple[str, str]] | None = None) -> Column:
    """Entities, tags and site suffixes out, blanks squeezed. table: as unescape's."""
    out = F.regexp_replace(unescape(F.coalesce(title, F.lit("")), table), "<[^>]+>", "")
    for suffix in R.TITLE_SUFFIXES:
        out = F.regexp_replace(out, "(?i)" + suffix, "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def valid_image(url: Column) -> Column:
    """An absolute url, not of an ad host, without the marks of icons."""
    host = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)
    return (host != "") & ~host.rlike("|".join(R.IMAGE_BLOCKED_HOSTS)) & ~F.lower(url).rlike("|".join(R.IMAGE_BLOCKED_PARTS))


def pick_image(df: DataFrame, html: str = "html", feed_images: tuple[str, ...] = ()) -> DataFrame:
    """The first valid image: feed columns in order, then og:image, twitter:image, itemprop, the first inline image."""
    page = F.coalesce(html, F.lit(""))
    meta = lambda key, name: F.regexp_extract(page, rf'(?is)<meta\b[^>]*{key}="{name}"[^>]*content="([^"]*)"', 1)
    found = [
        *(F.col(c) for c in feed_images),
        meta("property", "og:image"),
        meta("name", "twitter:image"),
        meta("itemprop", "image"),
        F.regexp_extract(page, r'(?is)<img\b[^>]*src="([^"]*)"', 1),
    ]
    return df.withColumn("image", F.get(F.filter(F.array(*found), lambda u: u.isNotNull() & valid_image(u)), F.lit(0)))


def clean_stats(df: DataFrame) -> DataFrame:
    """Attempted, success, failed, fallback, mean length and mean characters removed."""
    return df.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if("success").alias("success"),
        F.count_if(~F.col("success") & (F.col("content") == "")).alias("failed"),
        F.count_if(~F.col("success") & (F.col("content") != "")).alias("fallback"),
        F.round(F.avg("cleaned_length"), 6).alias("avg_length"),
        F.round(F.avg("chars_removed"), 6).alias("avg_removed"),
    )
