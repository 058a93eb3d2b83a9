"""The articles on single goals read line by line, as what the plan over windows is held to."""

import re

from corpusloom.functions import patterns as P


class _Lists:
    """Gathers a list and the line before it into one paragraph."""

    def __init__(self, item, opening=lambda line: False):
        self.item, self.opening, self.open = item, opening, None

    @staticmethod
    def entry(line: str) -> str:
        return line.replace("*", "") + ";; "

    def feed(self, line: str) -> list[str]:
        """The paragraphs that the line completes."""
        done = []
        if self.open is not None:
            if self.item(line):
                self.open += self.entry(line)
                return done
            done, self.open = [self.open], None
        elif self.opening(line) and not line.endswith(":"):
            self.open = self.entry(line)
            return done
        if line.endswith(":"):
            self.open = line
            return done
        return [*done, line]


def _star_first(line: str) -> bool:
    return line.startswith("*")


def _star_last(line: str) -> bool:
    return line.endswith("*")


def lead_section(lines):
    """(target, section, text) up to the first heading."""
    lists = _Lists(_star_first)
    for line in lines:
        heading = line.startswith("=")
        if heading and lists.open is None:
            return
        for text in lists.feed(line):
            yield "", "Lead section", text
        if heading:
            return


_NEXT_SECTION = re.compile(r"^==[\s\tA-Z].+$")


def named_section(lines, key: str):
    """The sections whose heading holds the key."""
    lists, name, closing = _Lists(_star_last, _star_last), None, False
    for line in lines:
        low = line.lower()
        if line.startswith(("== ", "==\t")) and key in low:
            name = line.replace("=", "").replace("\t", "").strip()
        elif name is None:
            continue
        elif (_NEXT_SECTION.match(line) and key not in low) or (line.startswith("===") and "custodian agencies" in low):
            if lists.open is None:
                return
            closing = True  # once the open list is done
        elif not line.startswith("=="):
            for text in lists.feed(line):
                yield "", name, text
            if closing:
                return


_TARGET = re.compile(r"^===\s?target.+$", re.IGNORECASE)
_TARGET_WORD = re.compile(r"===\s?[tT]argets?\s")


def target_sections(lines):
    """Each target's heading and what stands below it."""
    lists, target = _Lists(_star_first), None
    label = None
    for line in lines:
        if line.startswith("==="):
            if lists.open is not None:
                yield label, "Targets", lists.open
            lists, target = _Lists(_star_first), None
            if _TARGET.match(line):
                mark = ":" if ":" in line else ". "
                rest = _TARGET_WORD.sub("", line)
                target = rest[: rest.index(mark)].strip().removesuffix(".")
                label = target
                title = line.replace("=", "").strip()
                yield target, "Targets", title[title.index(mark) + 1 :].strip()
        elif target is None:
            continue
        elif line.startswith("== "):
            return
        else:
            for text in lists.feed(line):
                yield target, "Targets", text


def read_article(text: str):
    lines = [s for line in text.splitlines() if (s := line.strip())]
    yield from lead_section(lines)
    headings = [line.lower() for line in lines if line.startswith(("== ", "==\t"))]
    for key in P.SECTIONS:
        if any(key in heading for heading in headings):  # else the section isn't there
            yield from named_section(lines, key)
    yield from target_sections(lines)
