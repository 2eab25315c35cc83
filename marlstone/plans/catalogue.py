"""Label catalogues: what to look for, as data.

A catalogue is a list of groups of labels; labels nest. :func:`flatten` checks it and gives
rows with ids, parents, depth and order; rules that a nested label lacks come from its parent."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

POSITIONS = ("same_line", "before", "after", "prefer_before", "prefer_after", "between", "split", "related", "succession")
FORMATS = ("text", "company", "number", "units", "single_word", "acts_like_single_word", "licence_number", "date_or_purpose", "linked_licence")
MULTIPLE = ("first", "every_label", "every_value", "joined")


@dataclass(frozen=True)
class Rule:
    pattern: str
    anchored: bool = False
    whole_line: bool = False


@dataclass(frozen=True)
class Label:
    name: str = ""
    texts: Sequence[str] = ()
    position: str = "same_line"
    format: str = "text"
    ends: Sequence[str] = ()
    match_all: bool = False
    must_contain: Sequence[str] = ()
    removes: Sequence[Rule] = ()
    possibilities: Sequence[str] = ()
    multiple: str = "first"
    include_label_text: bool = False
    minimum_sub_matches: int = 0
    related_name: str = ""
    related_category: str = ""
    category: str = ""
    previous: int = 10
    following: int = 10
    sub_labels: Sequence["Label"] = field(default=())


@dataclass(frozen=True)
class FlatLabel:
    label_id: int
    parent_id: int | None
    depth: int
    group: str
    ord: int
    label: Label


def flatten(groups: Sequence[tuple[str, Sequence[Label]]]) -> list[FlatLabel]:
    """Depth-first rows of a catalogue, parents before children."""
    out: list[FlatLabel] = []

    def visit(label: Label, parent: int | None, depth: int, group: str, ord_: int, removes: Sequence[Rule]) -> None:
        if label.position not in POSITIONS or label.format not in FORMATS or label.multiple not in MULTIPLE:
            raise ValueError(f"label {label.name or label.texts}: unknown position, format or multiplicity")
        if label.position == "between" and not (label.texts and label.ends):
            raise ValueError(f"label {label.name}: a block needs texts and ends")
        if label.position == "related" and not label.related_category:
            raise ValueError(f"label {label.name}: a related value needs a category")
        label = label if label.removes else replace(label, removes=tuple(removes))
        me = len(out)
        out.append(FlatLabel(me, parent, depth, group, ord_, label))
        for i, sub in enumerate(label.sub_labels):
            visit(sub, me, depth + 1, group, i, label.removes)

    names = [g for g, _ in groups]
    if len(set(names)) != len(names):
        raise ValueError("group names must differ")
    for name, labels in groups:
        for i, label in enumerate(labels):
            visit(label, None, 0, name, i, ())
    return out
