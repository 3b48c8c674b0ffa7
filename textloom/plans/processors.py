"""Which processors a request runs, in which order, with which models."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

#: What each processor reads of the others.
REQUIRES: dict[str, tuple[str, ...]] = {
    "tokenize": (),
    "mwt": ("tokenize",),
    "pos": ("tokenize", "mwt"),
    "lemma": ("tokenize", "mwt", "pos"),
    "depparse": ("tokenize", "mwt", "pos", "lemma"),
    "ner": ("tokenize",),
    "constituency": ("tokenize", "mwt", "pos"),
    "sentiment": ("tokenize",),
    "coref": ("tokenize",),
}
#: The order they run in.
ORDER = ("tokenize", "mwt", "pos", "lemma", "constituency", "coref", "depparse", "sentiment", "ner")
#: What pretagged input has already.
PRETAGGED = ("lemma", "depparse", "constituency")


def parse(names: str) -> list[str]:
    """A comma list in any case; an unknown or missing name raises ValueError."""
    out = [n.strip().lower() for n in names.split(",")]
    if not names.strip() or "" in out:
        raise ValueError("no processor named")
    if unknown := [n for n in out if n not in REQUIRES]:
        raise ValueError(f"unknown: {', '.join(unknown)}")
    return list(dict.fromkeys(out))


def select(wanted: Iterable[str], available: Mapping[str, str], overrides: Mapping[str, str] | None = None, pretagged: bool = False, add: bool = False) -> dict[str, str]:
    """Processor -> model, in running order. tokenize brings mwt along where there is a model for it.

    A requirement that was not asked for raises ValueError, or is added with add. mwt is required only where available;
    pretagged input frees lemma, depparse and constituency of theirs but tokenize.
    """
    models = {**available, **(overrides or {})}
    chosen = set(wanted)
    if missing := chosen - models.keys():
        raise ValueError(f"no model: {', '.join(sorted(missing))}")
    if "tokenize" in chosen and "mwt" in models:
        chosen.add("mwt")
    todo = list(chosen)
    while todo:
        name = todo.pop()
        for need in REQUIRES[name]:
            if need in chosen or need == "mwt" and need not in models or pretagged and name in PRETAGGED and need not in ("tokenize", "mwt"):
                continue
            if not add or need not in models:
                raise ValueError(f"{name} requires {need}")
            chosen.add(need)
            todo.append(need)
    return {p: models[p] for p in ORDER if p in chosen}


def resolve(named: Mapping[str, str], registry: Mapping[str, Mapping[str, str]]) -> dict[str, str]:
    """Processor -> path for processor -> model name; endings are taken off, a name of two models raises ValueError."""
    out = {}
    for processor, name in named.items():
        bare = name.rsplit(".", 1)[0] if name.endswith((".parquet", ".json")) else name
        hits = [path for own, path in registry.get(processor, {}).items() if own == bare]
        if len(hits) != 1:
            raise ValueError(f"{processor}: {'no' if not hits else 'more than one'} model {bare}")
        out[processor] = hits[0]
    return out
