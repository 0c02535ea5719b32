"""Fill-in-middle: texts cut into prefix, middle and suffix, written with sentinels so that a model learns to fill the middle.

The tokenizers library's ``Split`` pre-tokenizer with an isolated regex match for every unit (a code point by default) gives the code-point
offsets of all units; nothing is trained. The number of a text's matches is its n, and the offsets of rank a and b are where the
text is sliced. The matches stay in the library's own encoding, which is asked for its length: no Python object is made for a unit, and
offsets are tracked only where a cut falls. Code points do not depend on what stands around them, so a text is matched in blocks, and the
two blocks of the cuts are matched again with offsets; a unit of another kind is matched over the whole text.

h1 to h4 are the first four 8-digit groups of the hexadecimal sha256 of the seed and the decimal id: cuts at h1 % (n + 1) and
h2 % (n + 1) units, plain where h3 % 100 >= ``plain_from``, suffix first where h4 % 100 < ``spm_below``.

Defined cases: a null text is empty; an empty text and one that holds a sentinel stay plain; a null id counts as an empty one (its rows are all
cut by the same fractions); repeated rows are cut alike; other columns are carried only if named in ``keep``; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.llm import _text as X
from loreline.llm._frames import col

CODE_POINT = r"(?m:.)"  # (?m: lets the dot match line ends too, in the library's regex dialect)
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20
BLOCK = 256  # code points that are matched at once
TOGETHER = 64  # blocks in one call


def splitter(unit: str = CODE_POINT):
    """The start of every unit of a text, in code points."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    split = Split(Regex(unit), "isolated")

    def starts(text: str) -> np.ndarray:
        step = BLOCK if unit == CODE_POINT else max(len(text), 1)
        blocks = [np.fromiter((at for _, (at, _) in split.pre_tokenize_str(text[k:k + step])), np.uint32) + np.uint32(k) for k in range(0, len(text), step)]
        return np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)

    return starts


def units(unit: str = CODE_POINT):
    """n of a text, and the start of its unit of any rank, in code points."""
    from tokenizers import Regex, Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Split

    coder = Tokenizer(WordLevel({"": 0}, unk_token=""))  # one token a match, whatever it holds
    coder.pre_tokenizer = Split(Regex(unit), "isolated")

    def of(text: str):
        step = BLOCK if unit == CODE_POINT else max(len(text), 1)
        blocks = [text[k:k + step] for k in range(0, len(text), step)]
        sizes = [len(x) for k in range(0, len(blocks), TOGETHER) for x in coder.encode_batch_fast(blocks[k:k + TOGETHER], add_special_tokens=False)]
        ends = list(accumulate(sizes))

        def start(rank: int) -> int:
            k = bisect_right(ends, rank)
            if k == len(ends):
                return len(text)
            return k * step + coder.encode(blocks[k], add_special_tokens=False).token_to_chars(rank - ends[k] + sizes[k])[0]

        return (ends[-1] if ends else 0), start

    return of


def cut(text: str, n: int, start, h: tuple[int, int, int, int], sentinels=SENTINELS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> tuple:
    """(n, form, code points of the prefix, of the middle, output) of one text of n units, of which ``start`` tells where each begins."""
    if not n or h[2] % 100 >= plain_from or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    a, b = (start(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    p, s, m = sentinels
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_below:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: str = "1:", sentinels: tuple[str, str, str] = SENTINELS,
                   plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, n (units), form, prefix_chars, middle_chars (null if plain), output, and the columns of ``keep``."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(col(id_col).cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring("__h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"__h{k}") for k in range(4)]
    carried = [f"__c{k}" for k in range(1 + len(keep))]  # names that clash with nothing
    rows = docs.select(*[col(c).alias(a) for c, a in zip((id_col, *keep), carried)], F.coalesce(col(text_col), F.lit("")).alias("__text"), digest.alias("__h"))
    rows = rows.select(*carried, "__text", *[F.conv(F.substring("__h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"__h{k}") for k in range(4)])
    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        of = units(unit)
        for b in X.slices(batches, "__text"):
            h = zip(*(b.column(f"__h{k}").to_pylist() for k in range(4)))
            made = [cut(t, *of(t), x, sentinels, plain_from, spm_below) for t, x in zip(b.column("__text").to_pylist(), h)]
            yield pa.record_batch({c: b.column(c) for c in carried} | {c: pa.array([m[k] for m in made], t) for k, (c, t) in enumerate(kinds.items())})

    schema = T.StructType([*rows.schema.fields[:len(carried)], *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string").fields])
    return rows.mapInArrow(run, schema).select(*[F.col(a).alias(c) for a, c in zip(carried, (id_col, *keep))], *kinds)


def restored(form: str = "form", output: str = "output", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text, rebuilt from form and output alone. No sentinel stands in a cut text, and none begins as another ends, so each is found at its first place."""
    out = col(output)
    p, s, m = ((F.instr(out, x), len(x)) for x in sentinels)
    between = lambda x, y: out.substr(x[0] + F.lit(x[1]), y[0] - x[0] - F.lit(x[1]))
    rest = out.substr(m[0] + F.lit(m[1]), F.length(out))
    return F.when(col(form) == "psm", F.concat(between(p, s), rest, between(s, m))).when(col(form) == "spm", F.concat(between(p, m), rest, between(s, p))).otherwise(out)
