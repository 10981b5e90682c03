"""Where a dataset comes from: source strings, subsets, and a catalogue of known datasets."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class SourceSpec:
    """`[hub::]name_or_path[:subset/subset][#rows]`."""

    name: str
    subsets: tuple[str, ...] = ()
    rows: int | None = None
    hub: str | None = None

    @staticmethod
    def parse(text: str, exists: Callable[[str], bool] = lambda path: False) -> SourceSpec:
        """A path that exists is taken whole at every step; rows follow the last `#`, subsets the first `:` (A4)."""
        if exists(text):
            return SourceSpec(text.strip())
        head, sep, tail = text.partition("::")
        hub, rest = (head.lower(), tail) if sep else (None, text)
        hub = hub if hub in ("hf", "ms") else None
        if exists(rest):
            return SourceSpec(rest.strip(), hub=hub)
        body, sep, count = rest.rpartition("#")
        body, rows = (body, int(count)) if sep else (rest, None)
        if exists(body):
            return SourceSpec(body.strip(), rows=rows, hub=hub)
        name, sep, subsets = body.partition(":")
        parts = tuple(s.strip() for s in subsets.split("/")) if sep else ()
        return SourceSpec(name.strip(), parts, rows, hub)


@dataclass(frozen=True)
class Subset:
    name: str
    splits: tuple[str, ...] = ("train",)
    weak: bool = False


@dataclass(frozen=True)
class Dataset:
    """A catalogue entry: where it lies, its subsets, and how its columns become canonical ones."""

    name: str
    path: str | None = None
    subsets: tuple[Subset, ...] = (Subset("default"),)
    columns: dict[str, str] = field(default_factory=dict)
    prepare: Callable | None = None
    tags: tuple[str, ...] = ()


def choose_subsets(dataset: Dataset, wanted: tuple[str, ...] = ()) -> list[Subset]:
    """None wanted: the only one, or `default`; `all`: all that aren't weak; unknown names are taken as they are (A5)."""
    known = {s.name: s for s in dataset.subsets}
    if not wanted:
        if len(known) <= 1:
            return list(known.values())
        if "default" in known:
            return [known["default"]]
        raise ValueError(f"name one of the subsets {sorted(known)}")
    if wanted == ("all",) and "all" not in known:
        return [s for s in dataset.subsets if not s.weak]
    return [known.get(w, Subset(w)) for w in wanted]


class Catalog:
    """Datasets by name; a name is found by its last path component too."""

    def __init__(self):
        self._by_name: dict[str, Dataset] = {}

    def register(self, dataset: Dataset, exist_ok: bool = False) -> Dataset:
        if dataset.name in self._by_name and not exist_ok:
            raise ValueError(f"{dataset.name} is registered already")
        self._by_name[dataset.name] = dataset
        return dataset

    def register_json(self, text: str, exist_ok: bool = False) -> list[Dataset]:
        """Entries of a JSON list: `name`, and optionally `path`, `subsets` (names or objects), `columns`, `tags`."""
        out = []
        for e in json.loads(text):
            subs = tuple(Subset(s) if isinstance(s, str) else Subset(s["name"], tuple(s.get("splits", ("train",))), s.get("weak", False)) for s in e.get("subsets", ["default"]))
            out.append(self.register(Dataset(e["name"], e.get("path"), subs, e.get("columns", {}), None, tuple(e.get("tags", ()))), exist_ok))
        return out

    def find(self, name: str) -> Dataset | None:
        if name in self._by_name:
            return self._by_name[name]
        parts = [p for p in name.rstrip("/").split("/") if p]
        if "snapshots" in parts:  # a snapshot folder is named owner--dataset above
            holder = parts[parts.index("snapshots") - 1]
            parts = ["/".join(holder.split("--")[1:])]
        last = parts[-1].split("/")[-1] if parts else ""
        hits = [d for n, d in self._by_name.items() if n.split("/")[-1] == last]
        return hits[0] if len(hits) == 1 else None

    def names(self) -> list[str]:
        return sorted(self._by_name)
