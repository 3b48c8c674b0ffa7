"""Annotated documents as JSON: a list of sentences, each a list of entries, two blanks a level."""

from __future__ import annotations

import json

from .conllu import format_misc, parse_misc
from .documents import Sentence, Token, Word

_FIELDS = ("lemma", "upos", "xpos", "feats", "head", "deprel", "start_char", "end_char")


def _marks(coref: str | None, texts: dict[int, str]) -> list[dict] | None:
    """start-repr-id3,unit-id4 as objects; each flag only where it is true."""
    if not coref:
        return None
    out = []
    for piece in coref.split(","):
        place, *rest = piece.split("-")
        index = int(rest[-1].removeprefix("id"))
        flags = {"is_start": place in ("unit", "start"), "is_end": place in ("unit", "end"), "is_representative": "repr" in rest}
        out.append({"index": index, "representative_text": texts.get(index, "_")} | {k: v for k, v in flags.items() if v})
    return out


def _plain_marks(marks: list[dict] | None) -> str | None:
    if not marks:
        return None
    place = {(True, True): "unit", (True, False): "start", (False, True): "end", (False, False): "middle"}
    return ",".join(f"{place[m.get('is_start', False), m.get('is_end', False)]}-{'repr-' if m.get('is_representative') else ''}id{m['index']}" for m in marks)


def write(sentences: list[Sentence], representatives: dict[int, str] | None = None) -> str:
    out = []
    for s in sentences:
        rows: list[dict] = []
        for t, w in s.in_order():
            head = {"id": [w.id, w.empty_index] if t is None else w.id, "text": w.text}
            entry = head | {k: getattr(w, k) for k in _FIELDS} | {"coref_chains": _marks(w.coref, representatives or {})}
            if t is not None:
                misc = format_misc(t.space_after, t.spaces_before)
                own = {"ner": t.ner, "multi_ner": t.ner and [t.ner], "misc": None if misc == "_" else misc}
                if not t.is_mwt:
                    entry |= own
                elif w is t.words[0]:
                    both = {"id": [w.id, t.words[-1].id], "text": t.text, "start_char": t.start_char, "end_char": t.end_char} | own
                    rows.append({k: v for k, v in both.items() if v is not None})
            rows.append({k: v for k, v in entry.items() if v is not None})
        out.append(rows)
    return json.dumps(out, indent=2, ensure_ascii=False)


def read(text: str) -> list[Sentence]:
    """The sentences of a document; what is not of this shape raises ValueError."""
    try:
        return [_sentence(i, rows) for i, rows in enumerate(json.loads(text))]
    except (TypeError, KeyError, AttributeError) as e:
        raise ValueError(f"not an annotated document: {e}") from e


def _sentence(index: int, rows: list[dict]) -> Sentence:
    s = Sentence(str(index))
    group, group_end, last = None, 0, 0
    for e in rows:
        misc = parse_misc(e.get("misc") or "_")
        own = {"start_char": e.get("start_char"), "end_char": e.get("end_char"), "space_after": misc["space_after"], "spaces_before": misc["spaces_before"], "ner": e.get("ner")}
        if isinstance(e["id"], list) and e["id"][0] > last:
            group, group_end = Token(e["text"], is_mwt=True, **own), e["id"][-1]
            s.tokens.append(group)
            continue
        number = e["id"][0] if isinstance(e["id"], list) else e["id"]
        word = Word(number, e["text"], **{k: e.get(k) for k in _FIELDS}, coref=_plain_marks(e.get("coref_chains")))
        if isinstance(e["id"], list):
            word.empty_index = e["id"][1]
            s.empty.append(word)
            continue
        last = number
        if group is not None and number <= group_end:
            group.words.append(word)
        else:
            group = None
            s.tokens.append(Token(e["text"], words=[word], **own))
    return s
