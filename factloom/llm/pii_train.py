"""Trains the model of personal items: python -m factloom.llm.pii_train FOLDER [ROWS [EPOCHS [more]]].

Labelled spans come from at most ROWS texts of each source (a bounded, documented sample; the default is 9000): the exact forms mark
e-mail addresses, numbers and street addresses, the clean subject_name column marks names. Copies with other digits, other letter
case and unseen surnames are added. A tenth of the texts is held out; its span accuracy is printed.
"""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import regex as re

from factloom.llm import pii_model, pii_rules

WEIGHTS = Path(__file__).with_name("pii_weights.npz")


def _varied(text: str, found: list, r: random.Random) -> tuple[str, list]:
    chars = list(text)
    if r.random() < 0.7:
        chars = [r.choice("0123456789") if c in "0123456789" and r.random() < 0.8 else c for c in chars]
    for kind, b, e in found:
        if kind == "name" and r.random() < 0.4:
            for m in re.finditer(r"\p{Lu}\p{Ll}{3,}", "".join(chars[b:e])):
                k = b + m.start() + r.randrange(1, len(m.group()))
                chars[k] = r.choice("aeioulnrst")
        elif kind == "name" and r.random() < 0.1:
            chars[b:e] = [c.upper() if len(c.upper()) == 1 else c for c in chars[b:e]]
    return "".join(chars), found


def examples(folder: str, rows: int, seed: int = 7) -> list[tuple[str, list]]:
    r = random.Random(seed)
    files = pq.read_table(f"{folder}/package_files.parquet", columns=["id_number", "account_number", "subject_name"]).to_pydict()
    names = sorted({x for x in files["subject_name"] if x})
    given, surnames = set(), set()
    for n in names:
        plain = re.sub(rf"^(?:{pii_rules.TITLES}\.?\s+)+", "", pii_model.fold(n))
        words = [w.lower() for w in re.findall(r"[\p{L}']{2,}", plain)]
        if "," in plain:
            given.add(words[-1])
            words = words[:-1]
        elif len(words) > 1 and not re.match(r"\p{Lu}\.|(?:van|von|de)\s", plain):
            given.add(words[0])
            words = words[1:]
        surnames |= {p for w in words for p in re.findall(r"\p{L}{2,}", w) if p not in ("van", "der", "von", "de", "la")}
    texts = sorted({x for x in pq.read_table(f"{folder}/text_blocks.parquet", columns=["content"]).column(0).to_pylist() if x})
    r.shuffle(texts)
    marked = [x for x in texts if re.search(r"\d{4}|@|\[at\]|\b(?:Mr|Mrs|Ms|Dr|Judge|Sr|Herr|Frau|Justice)\b", x)][: rows * 2 // 3]
    texts = marked + texts[: rows // 3]
    numbers = sorted({x for c in ("id_number", "account_number") for x in files[c] if x})
    r.shuffle(numbers)
    out = [(t, pii_rules.label(t, given, surnames)) for t in texts + numbers[: rows // 2]]
    for n in names[: rows // 4]:
        lead = r.choice(["holder: ", "", "Before ", "counsel ", "for "])
        t = lead + n + r.choice(["", ", sitting as a deputy.", " for the appellant."])
        out.append((t, pii_rules.label(t, given, surnames)))
    print(len(given), "given names,", len(surnames), "surnames,", len(out), "texts")
    return out


def main(folder: str, rows: int = 9000, epochs: int = 6, more: str = "", minutes: float = 20) -> None:
    r, every = random.Random(11), examples(folder, rows)
    r.shuffle(every)
    held, train = every[: len(every) // 10], every[len(every) // 10 :]
    train = train + [_varied(t, f, r) for t, f in train if f]
    start = {k: v.astype(np.float32) for k, v in np.load(WEIGHTS).items()} if more else None
    p = pii_model.fit(train, epochs=epochs, rate=1e-3 if more else 4e-3, start=start, minutes=minutes, log=lambda s: print(s, flush=True))
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in p.items()})
    right = wanted = got = 0
    for (t, f), d in zip(held, pii_model.decode(p, [t for t, _ in held])):
        a, b = {(k, x) for k, x, _ in f}, {(k, x) for k, x, _ in pii_rules.checked(t, d)}
        right, wanted, got = right + len(a & b), wanted + len(a), got + len(b)
    print(f"held out: precision {right / max(got, 1):.4f}, recall {right / max(wanted, 1):.4f} of {wanted} spans")


if __name__ == "__main__":
    main(sys.argv[1], *[int(x) for x in sys.argv[2:4]], *sys.argv[4:5])
