"""Settings of a review: rubric, rules, thresholds. Defaults are the values in force."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Section:
    name: str
    patterns: tuple[str, ...]
    weight: float = 1.0


@dataclass(frozen=True)
class Dimension:
    name: str
    weight: float = 0.2
    description: str = ""


@dataclass(frozen=True)
class Completeness:
    sections: tuple[Section, ...] = ()
    sections_weight: float = 40.0
    min_words: int = 2000
    words_weight: float = 30.0
    min_references: int = 0
    references_weight: float = 0.0
    min_figures: int = 3
    figures_weight: float = 15.0
    min_paragraphs: int = 10
    max_long_share: float = 0.3
    format_weight: float = 15.0
    penalty: float = 0.12
    penalty_floor: float = 0.4
    complete_at: float = 60.0
    may_miss: int = 2

    @property
    def total(self) -> float:
        return self.sections_weight + self.words_weight + self.references_weight + self.figures_weight + self.format_weight or 100.0


@dataclass(frozen=True)
class Detection:
    patterns: tuple[str, ...] = ()
    threshold: float = 0.6
    image_weight: float = 0.25


@dataclass(frozen=True)
class Similarity:
    char_size: int = 8
    word_size: int = 3
    hashes: int = 128
    suspect: float = 0.4
    high: float = 0.6
    min_match: int = 30


@dataclass(frozen=True)
class Scale:
    low: float = 0.0
    high: float = 100.0
    out_low: float = 0.0
    out_high: float = 100.0
    exponent: float = 1.0


@dataclass(frozen=True)
class Rubric:
    dimensions: tuple[Dimension, ...] = ()
    completeness: Completeness = field(default_factory=Completeness)


def rubric_from(config: dict) -> Rubric:
    """A rubric from a parsed settings file; absent values keep their defaults."""
    dims = tuple(Dimension(d["name"], float(d.get("weight", 0.2)), d.get("description", "")) for d in config.get("dimensions", []))
    c = config.get("completeness", {})
    part = lambda k: c.get(k) or {}
    d = Completeness()
    return Rubric(
        dims,
        Completeness(
            sections=tuple(Section(s["name"], tuple(map(str, s.get("patterns", [s["name"]]))), float(s.get("weight", 1))) for s in c.get("sections", [])),
            sections_weight=float(c.get("sections_weight", d.sections_weight)),
            min_words=int(part("word_count").get("min", d.min_words)),
            words_weight=float(part("word_count").get("weight", d.words_weight)),
            min_references=int(part("references").get("min", d.min_references)),
            references_weight=float(part("references").get("weight", d.references_weight)),
            min_figures=int(part("figures").get("min", d.min_figures)),
            figures_weight=float(part("figures").get("weight", d.figures_weight)),
            min_paragraphs=int(part("format").get("min_paragraphs", d.min_paragraphs)),
            max_long_share=float(part("format").get("max_long_line_ratio", d.max_long_share)),
            format_weight=float(part("format").get("weight", d.format_weight)),
        ),
    )
