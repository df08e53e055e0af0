"""Language identification by unigram models that sum over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum, over all ways to
cut it into pieces, of the products of their probabilities; the forward algorithm gets it for all languages at once, and a text's
log probability is the sum over its words (those of over BLOCK characters are summed in logarithms, against underflow).

Learning. Texts with a language are taken from a sample of at most SAMPLE expected rows per language, chosen by a hash of
doc_id; words are counted, and EM splits each word's count over its segmentations: tasks get a forward-backward pass over the
words they hold and return expected counts of pieces, which are summed per language. Languages are taken AT_ONCE in name order: their
probabilities are one matrix of at most vocabulary x AT_ONCE, the only one that the driver or a task holds. Where there are more, counts stay
in tables, and texts pass the blocks one after the other with the best language and the sum so far, so that all languages are compared.

Texts are put in lower case. A task scores a word once while it remembers it. The score is the chosen language's share of the probability of all.

Defined results: a null text, and one without a letter, is `und` with score 0; with nothing to learn from every text is `und`; rows
without doc_id have held_out null and are not learned from; of equally likely languages the first by name is taken; repeated rows are
judged one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm._shared import PIECE, decoded, documents, lean, stash

#: Expected rows per language that are learned from, and languages whose model is sent to the tasks at once.
SAMPLE, AT_ONCE = 2000, 256
#: Languages up to which their names and shares are sent to every task.
BROADCAST_LANGUAGES = 20_000
#: About how many bytes of words and their scores a task remembers; beyond, it starts anew.
REMEMBERED = 80_000_000
ROUNDS, BLOCK, STRIDE = 2, 32, 4096
#: Characters of the longest piece that is looked for at least; a vocabulary with longer ones is searched up to its own longest.
LONGEST = 16
#: Probability of a character that no piece covers; weight of the smoothing over the whole vocabulary.
UNKNOWN, SMOOTHING = 1e-7, 0.02


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the pieces, their numbers, and the length up to which pieces are looked for."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {found.id_to_piece(k) for k in range(found.get_piece_size()) if not (found.is_byte(k) or found.is_control(k) or found.is_unknown(k))}
    pieces = sorted(pieces)
    hashes = np.array([_hash_one(x) for x in pieces], np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order, max(LONGEST, *map(len, pieces))


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _step(hashed: np.ndarray, char: np.ndarray) -> np.ndarray:
    hashed = (hashed ^ char.astype(np.uint64)) * _MULTIPLIER
    return hashed ^ (hashed >> np.uint64(29))


def _hash_one(piece: str) -> int:
    hashed = np.ones(1, np.uint64)
    for char in piece:
        hashed = _step(hashed, np.array([ord(char)], np.uint64))
    return int(hashed[0])


def _by_length(words: list[str], languages: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the words of each length and their characters as a matrix, fewer at once for more languages; a word starts with the mark of a new word."""
    most = max(64, 80_000 // max(1, languages))
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        for part in np.array_split(at, len(at) // most + 1):
            yield part, np.frombuffer("".join(words[k] for k in part.tolist()).encode("utf-32-le"), np.uint32).reshape(len(part), n)


def _pieces(chars: np.ndarray, path: str) -> dict[tuple[int, int], np.ndarray]:
    """For each start and end, the piece there in each word, or -1."""
    hashes, numbers, longest = vocabulary(path)
    found = {}
    for start in range(chars.shape[1]):
        hashed = np.ones(len(chars), np.uint64)
        for end in range(start + 1, min(start + longest, chars.shape[1]) + 1):
            hashed = _step(hashed, chars[:, end - 1])
            at = np.minimum(np.searchsorted(hashes, hashed), len(hashes) - 1)
            found[start, end] = np.where(hashes[at] == hashed, numbers[at], -1)
    return found


def _forward(found: dict, chars: np.ndarray, model: np.ndarray) -> list[np.ndarray]:
    """Sums over the segmentations of each word's first characters, for each language; model has a last row for characters that no piece covers."""
    rows, n = chars.shape
    alpha = [np.ones((rows, model.shape[1]))] + [np.zeros((rows, model.shape[1])) for _ in range(n)]
    for end in range(1, n + 1):
        for start in range(end):
            if (start, end) not in found:
                continue
            piece = found[start, end]
            if end - start == 1:
                alpha[end] += alpha[start] * model[piece]  # -1 is the last row
            else:
                known = np.flatnonzero(piece >= 0)
                alpha[end][known] += alpha[start][known] * model[piece[known]]
    return alpha


def _padded(words: list[str], languages: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of the words, their lengths and their characters as a matrix, padded with 0, for groups of words of alike lengths."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(-lengths, kind="stable")
    lo = 0
    while lo < len(order):
        at = order[lo : lo + max(1, 16 * STRIDE // max(4, languages) // int(lengths[order[lo]]))]
        chars = np.zeros((len(at), int(lengths[at[0]])), np.uint32)
        for row, k in enumerate(at.tolist()):
            chars[row, : lengths[k]] = np.frombuffer(words[k].encode("utf-32-le"), np.uint32)
        yield at, lengths[at], chars
        lo += len(at)


def _ending(chars: np.ndarray, lo: int, hi: int, none: int, path: str) -> np.ndarray:
    """For each word, place from lo to hi and length less 1: the piece that ends there, none - 1 for an unknown character, none for no piece."""
    hashes, numbers, longest = vocabulary(path)
    found = np.full((len(chars), hi - lo, longest), none)
    for size in range(1, min(longest, hi) + 1):
        first = max(lo, size - 1)  # the first place where so long a piece can end
        hashed = np.ones((len(chars), hi - first), np.uint64)
        for k in range(size):
            hashed = _step(hashed, chars[:, first - size + 1 + k : hi - size + 1 + k])
        at = np.minimum(np.searchsorted(hashes, hashed), len(hashes) - 1)
        found[:, first - lo :, size - 1] = np.where(hashes[at] == hashed, numbers[at], none - 1 if size == 1 else none)
    return found


def _log_model(model: np.ndarray) -> np.ndarray:
    """Logarithms of the model, with one more row for what is no piece."""
    return np.concatenate([np.log(np.maximum(model, 1e-300)), np.full((1, model.shape[1]), -np.inf)])


def _log_sum(terms: np.ndarray) -> np.ndarray:
    top = np.maximum(terms.max(0), -1e300)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(terms - top).sum(0))


def _log_forward(chars: np.ndarray, logs: np.ndarray, path: str) -> np.ndarray:
    """Logarithms of _forward's sums: places x words x languages. What follows a word's end means nothing."""
    rows, n = chars.shape
    alpha = np.zeros((n + 1, rows, logs.shape[1]))
    for lo in range(0, n, STRIDE):
        pieces = _ending(chars, lo, min(n, lo + STRIDE), len(logs) - 1, path)
        for end in range(lo + 1, min(n, lo + STRIDE) + 1):
            k = min(end, pieces.shape[2])
            alpha[end] = _log_sum(alpha[end - k : end][::-1] + logs[pieces[:, end - 1 - lo, :k]].transpose(1, 0, 2))
    return alpha


def _log_totals(chars: np.ndarray, lengths: np.ndarray, logs: np.ndarray, path: str) -> np.ndarray:
    """Logarithms of the whole words' sums. Of the places of a long word only those that a piece can still start from are held."""
    (rows, n), longest = chars.shape, vocabulary(path)[2]
    out, last = np.zeros((rows, logs.shape[1])), np.zeros((1, rows, logs.shape[1]))
    for lo in range(0, n, STRIDE):
        hi, base = min(n, lo + STRIDE), len(last) - 1
        pieces = _ending(chars, lo, hi, len(logs) - 1, path)
        alpha = np.concatenate([last, np.zeros((hi - lo, *last.shape[1:]))])
        for end in range(lo + 1, hi + 1):
            k, at = min(end, pieces.shape[2]), base + end - lo
            alpha[at] = _log_sum(alpha[at - k : at][::-1] + logs[pieces[:, end - 1 - lo, :k]].transpose(1, 0, 2))
        here = np.flatnonzero((lengths > lo) & (lengths <= hi))
        out[here] = alpha[base + lengths[here] - lo, here]
        last = alpha[-longest:]
    return out


def _log_expected(chars: np.ndarray, lengths: np.ndarray, counts: np.ndarray, model: np.ndarray, path: str, total: np.ndarray) -> None:
    """Adds the expected pieces of padded words to total, in the languages in which they are counted."""
    used = np.flatnonzero(counts.any(0))
    counts, model, out = counts[:, used], model[:, used], np.zeros((len(total), len(used)))
    logs, (rows, n) = _log_model(model), chars.shape
    longest, each = vocabulary(path)[2], np.arange(rows)
    alpha = _log_forward(chars, logs, path)
    whole = alpha[lengths, each]
    beta = np.full((n + 1 + longest, rows, model.shape[1]), -np.inf)
    beta[lengths, each] = 0
    for hi in range(n, 0, -STRIDE):
        lo = max(0, hi - STRIDE)
        pieces = _ending(chars, lo, min(n, hi + longest), len(logs) - 1, path)
        for start in range(hi - 1, lo - 1, -1):
            sizes = np.arange(min(longest, n - start))
            piece = pieces[:, start + sizes - lo, sizes].T
            terms = logs[piece] + beta[start + 1 : start + 1 + len(sizes)]
            beta[start] = np.where((lengths == start)[:, None], beta[start], _log_sum(terms))
            size, row = np.nonzero((piece < len(logs) - 1) & (start + sizes[:, None] < lengths))
            np.add.at(out, piece[size, row], np.exp(alpha[start][row] + terms[size, row] - whole[row]) * counts[row])
    total[:, used] += out


def _short_and_long(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words with a mark before each, and the numbers of those of at most BLOCK characters and of the others."""
    words = ["▁" + word for word in words]
    short = np.array([len(word) <= BLOCK for word in words], bool)
    return words, np.flatnonzero(short), np.flatnonzero(~short)


def word_scores(words: list[str], model: np.ndarray, path: str) -> np.ndarray:
    """Log probability of each word in each language."""
    words, short, long = _short_and_long(words)
    out = np.zeros((len(words), model.shape[1]))
    for at, chars in _by_length([words[k] for k in short.tolist()], model.shape[1]):
        out[short[at]] = np.log(np.maximum(_forward(_pieces(chars, path), chars, model)[-1], 1e-300))
    for at, lengths, chars in _padded([words[k] for k in long.tolist()], model.shape[1]):
        out[long[at]] = _log_totals(chars, lengths, _log_model(model), path)
    return out


def expected_pieces(words: list[str], counts: np.ndarray, model: np.ndarray, path: str) -> np.ndarray:
    """Expected number of each piece: counts (words x languages) split over each word's segmentations."""
    total = np.zeros_like(model)
    words, short, long = _short_and_long(words)
    for at, lengths, chars in _padded([words[k] for k in long.tolist()], model.shape[1]):
        _log_expected(chars, lengths, counts[long[at]], model, path, total)
    counts = counts[short]
    for at, chars in _by_length([words[k] for k in short.tolist()], model.shape[1]):
        found, n = _pieces(chars, path), chars.shape[1]
        alpha = _forward(found, chars, model)
        beta = [np.zeros_like(alpha[0]) for _ in range(n)] + [np.ones_like(alpha[0])]
        weight = counts[at] / np.maximum(alpha[n], 1e-300)
        for start in range(n - 1, -1, -1):
            for end in range(start + 1, n + 1):
                if (start, end) not in found:
                    break
                piece = found[start, end]
                known = np.arange(len(piece)) if end - start == 1 else np.flatnonzero(piece >= 0)
                here = model[piece[known]] * beta[end][known]
                beta[start][known] += here
                np.add.at(total, piece[known], here * alpha[start][known] * weight[known])
    return total


def words_of(text: str) -> list[str]:
    return text.lower().split()


class _Scored(dict):
    """Places of words in a matrix of their scores; new words wait until settle() scores them together."""

    def __init__(self, model: np.ndarray, path: str):
        self.model, self.path, self.waiting = model, path, []
        self.scores = np.zeros((0, model.shape[1]))

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        self.waiting.append(word)
        return found

    def settle(self) -> np.ndarray:
        if self.waiting:
            self.scores = np.concatenate([self.scores, word_scores(self.waiting, self.model, self.path)])
            self.waiting = []
        return self.scores


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _normal(counts: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Piece probabilities of counted languages, smoothed by the pieces' shares of all languages' counts."""
    n = len(counts) - 1
    own = counts[:-1] / np.maximum(counts[:-1].sum(0), 1)
    model = (1 - 2 * SMOOTHING) * own + SMOOTHING * every[:, None] + SMOOTHING / n
    return np.concatenate([model, np.full((1, counts.shape[1]), UNKNOWN)])


def train(rows: DataFrame, path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> Iterator[tuple[list[str], np.ndarray]]:
    """From rows (doc_id, text, lang): blocks of languages, in name order, each with its piece probabilities, a row per piece and a last one for unknown characters."""
    spark, n_pieces = rows.sparkSession, len(vocabulary(path)[0])
    sizes = {x["lang"]: x["n"] for x in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    blocks = [languages[k : k + AT_ONCE] for k in range(0, len(languages), AT_ONCE)]
    if not blocks:
        return
    drawn = spark.createDataFrame([(name, k // AT_ONCE, k % AT_ONCE, min(1.0, sample / sizes[name])) for k, name in enumerate(languages)], "lang string, block int, number long, share double")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("lang-1:"), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    drawn = F.broadcast(drawn) if len(languages) <= BROADCAST_LANGUAGES else drawn
    chosen = stash(rows.join(drawn, "lang").filter(draw < F.col("share")).select("block", "number", "text"))

    def run(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("number").to_pylist()
            for lo, _, each in decoded(batch.column("text"), _step_bytes(model.shape[1])):
                seen: dict[str, np.ndarray] = {}
                for number, text in zip(numbers[lo:], each):
                    for word in words_of(text):
                        seen.setdefault(word, np.zeros(model.shape[1]))[number] += 1
                if seen:
                    total = expected_pieces(list(seen), np.array(list(seen.values())), model, path)
                    piece, number = np.nonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(number), pa.array(total[piece, number])], ["piece", "number", "n"])

    def counted(tables: list[DataFrame], k: int) -> np.ndarray:
        counts = np.zeros((n_pieces + 1, len(blocks[k])))
        for x in tables[k].toArrow().to_batches():  # one block of languages
            counts[x.column("piece").to_numpy(), x.column("number").to_numpy()] = x.column("n").to_numpy()
        return counts

    def model_of(tables: list[DataFrame] | None, every: np.ndarray, k: int) -> np.ndarray:
        if tables is None:
            return np.concatenate([np.full((n_pieces, len(blocks[k])), 1.0 / n_pieces), np.full((1, len(blocks[k])), UNKNOWN)])
        return _normal(counted(tables, k), every)

    tables, every = None, np.zeros(n_pieces)
    for _ in range(rounds):
        found = []
        for k in range(len(blocks)):
            sent = spark.sparkContext.broadcast(model_of(tables, every, k))
            expected = chosen.filter(F.col("block") == k).select("number", "text").mapInArrow(lean(lambda x, sent=sent: run(x, sent.value)), "piece long, number long, n double")
            found.append(stash(expected.groupBy("piece", "number").agg(F.sum("n").alias("n"))))
            sent.unpersist()
        tables, every = found, np.zeros(n_pieces)
        for table in tables:
            for piece, n in table.filter(F.col("piece") < n_pieces).groupBy("piece").agg(F.sum("n")).collect():  # one number for each piece of the vocabulary
                every[piece] += n
        every /= max(every.sum(), 1)
    for k, names in enumerate(blocks):
        yield names, model_of(tables, every, k)


def _step_bytes(languages: int) -> int:
    """Bytes of text that one step scores: fewer for more languages, as each new word has a number for each."""
    return int(min(4 * PIECE, max(1 << 16, 16 * REMEMBERED // (8 * languages + 130))))


def _scored(rows: DataFrame, names: list[str], model: np.ndarray, path: str) -> DataFrame:
    """rows (doc_id, held_out, text, lang_pred, top, mass) after these languages too: the likeliest so far, its log probability and the logarithm of all probabilities' sum."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    most = REMEMBERED // (8 * len(names) + 130)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _Scored(sent.value, path)
        for batch in batches:
            for lo, hi, each in decoded(batch.column("text"), _step_bytes(len(names))):
                if len(scored) > most:
                    scored = _Scored(sent.value, path)
                places = [np.fromiter(map(scored.__getitem__, words_of(x)), np.int64) for x in each]
                scores, total = scored.settle(), np.zeros((len(each), len(names)))
                for k, place in enumerate(places):
                    total[k] = scores[place].sum(0)
                part, best = batch.slice(lo, hi - lo), total.argmax(1)
                own = total.max(1)
                own_mass = own + np.log(np.exp(total - own[:, None]).sum(1))
                top, mass = (part.column(c).to_numpy() for c in ("top", "mass"))
                known, better = np.array([has_letter(x) for x in each], bool), own > top  # of equals the earlier name stays
                named = [(names[b] if new else old) if ok else "und" for b, new, old, ok in zip(best.tolist(), better.tolist(), part.column("lang_pred").to_pylist(), known.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), part.column("text"), pa.array(named, pa.string()), pa.array(np.maximum(own, top)), pa.array(np.logaddexp(own_mass, mass))], ["doc_id", "held_out", "text", "lang_pred", "top", "mass"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(lean(run), f"doc_id {kinds['doc_id']}, held_out boolean, text string, lang_pred string, top double, mass double")


def identify(docs: DataFrame, tokenizer: str | None = None, **parameters) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row. Rows whose crc32(doc_id as text) mod 3 is 1 are not learned from."""
    path = tokenizer or default_path()
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    none = F.lit(float("-inf"))
    rows, n = docs.select("doc_id", held.alias("held_out"), "text", F.lit("und").alias("lang_pred"), none.alias("top"), none.alias("mass")), 0
    for names, model in train(docs.filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"), path, **parameters):
        rows = _scored(stash(rows) if n else rows, names, model, path)  # texts are written once more for each block behind the first
        n += 1
    sure = F.when(F.col("lang_pred") != "und", F.exp(F.col("top") - F.col("mass"))).otherwise(0.0) if n else F.lit(0.0)
    return rows.select("doc_id", "held_out", "lang_pred", sure.alias("score"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir, "doc_id", "text", "lang"))
