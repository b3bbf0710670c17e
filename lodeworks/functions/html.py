"""Page structure: regular expressions for the flat rules, a tag walk for nested ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.exprs import col, nonempty, strip
from lodeworks.functions.names import NameRules, valid_document_name, valid_list_name

TAGS = r"<[^>]+>"
# Pages whose texts a task holds as Python objects at once.
WALKED = 64


def inner_texts(html: Column | str, tag: str) -> Column:
    """Texts of every ``tag`` element, inner tags dropped."""
    raw = F.regexp_extract_all(
        col(html), F.lit(rf"(?is)<(?:{tag})(?:\s[^>]*)?>(.*?)</(?:{tag})>"), F.lit(1)
    )
    return F.transform(raw, lambda t: strip(F.regexp_replace(t, TAGS, "")))


def text_lines_of(html: Column | str) -> Column:
    """One entry per text node: every tag is a line break."""
    s = F.regexp_replace(col(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "\n")
    return F.filter(
        F.transform(F.split(F.regexp_replace(s, TAGS, "\n"), "\n"), lambda t: strip(t)),
        lambda t: t != "",
    )


def candidate_names(html: Column | str, rules: NameRules) -> Column:
    """Valid names from links, headings and text lines; sorted and distinct."""
    found = F.concat(inner_texts(html, "a"), inner_texts(html, "h[1-4]"), text_lines_of(html))
    return F.sort_array(F.array_distinct(F.filter(found, lambda t: valid_list_name(t, rules))))


def listed_names(html: Column | str, suffix_words: Sequence[str], veto: Sequence[str]) -> Column:
    """List items: the part before a colon, parentheses dropped, a suffix word required."""
    items = inner_texts(html, "li|p")
    names = F.transform(
        items,
        lambda t: F.trim(F.regexp_replace(F.regexp_extract(t, r"^([^:]*)", 1), r"\([^)]*\)", "")),
    )

    def fits(t: Column) -> Column:
        low = F.lower(t)
        ok = F.length(t).between(3, 80)
        has = F.lit(False)
        for w in suffix_words:
            has = has | low.contains(w)
        for v in veto:
            ok = ok & ~F.startswith(low, F.lit(v))
        return ok & has

    return F.array_distinct(F.filter(names, fits))


def firm_from_board_line(
    line: Column | str, roles: Sequence[str], trailing: Sequence[str] = (), rules: NameRules | None = None
) -> Column:
    """``FIRST LAST Firm Name, Role`` to the firm name.

    From a ``trailing`` role or form word on the name is cut; with ``rules`` it must be a valid
    document name, else there is none.
    """
    found = F.regexp_extract(
        col(line),
        rf"^([A-Z][A-Z.\-']+(?:\s+[A-Z][A-Z.\-']+)+)\s+([A-Z][^,]+),\s*(?:{'|'.join(roles)})",
        2,
    )
    if trailing:
        found = F.regexp_replace(found, rf",?\s*(?:{'|'.join(trailing)}).*$", "")
    name = nonempty(strip(found))
    return name if rules is None else F.when(valid_document_name(name, rules), name)


def page_title(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(col(html), r"(?is)<title>(.*?)</title>", 1))


def walk_sections(
    pages: DataFrame, key: str, html: str, section_words: Sequence[str], item_tags: Sequence[str]
) -> DataFrame:
    """(key, section, item): texts of item tags inside elements whose class or id
    carries a section word. The page is walked tag by tag inside the task; each
    page is independent, so the rows may lie on any partition.
    """
    wanted = list(section_words)
    items = set(item_tags)
    step = WALKED
    schema = pages.select(key).schema.fields[0].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from html.parser import HTMLParser

        import pyarrow

        void = {"br", "hr", "img", "input", "meta", "link"}

        class Walker(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.stack, self.rows, self.texts = [], [], []

            def handle_starttag(self, tag, attrs):
                if tag in void:
                    return
                if tag in items and self.stack and self.stack[-1][0] == tag:
                    self.handle_endtag(tag)  # an item that was not closed ends here
                mark = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
                section = next((w for w in wanted if w in mark), None)
                if section is None and self.stack:
                    section = self.stack[-1][1]
                self.stack.append((tag, section, len(self.texts)))

            def handle_data(self, data):
                self.texts.append(data)

            def handle_endtag(self, tag):
                if tag not in {t for t, _, _ in self.stack}:
                    return
                while self.pop() != tag:
                    pass

            def pop(self):
                name, section, start = self.stack.pop()
                if name in items and section:
                    text = " ".join(" ".join(self.texts[start:]).split())
                    if text:
                        self.rows.append((section, text))
                return name

            def finish(self):
                self.close()
                while self.stack:
                    self.pop()

        for batch in batches:
            # A batch may hold thousands of pages; only a few are Python texts at a time.
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                at, sections, texts = [], [], []
                for i, page in enumerate(part.column(1).to_pylist()):
                    walker = Walker()
                    walker.feed(page or "")
                    walker.finish()
                    at += [i] * len(walker.rows)
                    sections += [s for s, _ in walker.rows]
                    texts += [t for _, t in walker.rows]
                yield pyarrow.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pyarrow.array(at, pyarrow.int64())),
                        pyarrow.array(sections, pyarrow.string()),
                        pyarrow.array(texts, pyarrow.string()),
                    ],
                    [key, "section", "item"],
                )

    return pages.select(key, html).mapInArrow(walk, f"{key} {schema}, section string, item string")
