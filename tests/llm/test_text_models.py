"""Language, quality, toxicity and SentencePiece coding."""

import os
import random
import resource
import struct

import numpy as np
import pytest

from quillboard.llm import fitting, langid, minhash, quality_crf, textnp, toxicity, unigram

ODD = [None, "", " ", "\n\n", "\u0000", "123 !?", "x", "a" * 3000, "日本語 テキスト", "😀" * 50, "é̀", "word " * 50_000]
DOCS = "doc_id bigint, text string, lang string, score string"


@pytest.fixture
def small_pieces(monkeypatch):
    def set_to(n):
        for module in (textnp, langid, toxicity, unigram):
            monkeypatch.setattr(module, "PIECE_CHARS", n, raising=False)

    return set_to


MIXED = ["ab cd " * 40 + "x" * 333, "a word, a word a word;" * 30, "tok  tok tok\n" * 30 + "ri" * 200, None, "", "one", " lead and trail  ", "é▁日本 😀 " * 20]


def test_blocks_hold_whole_texts_in_order():
    blocks = list(textnp.text_blocks(["abcdef" * 10, None, "y"], 20, lambda t: [t[:33], t[33:]]))
    assert "".join(p for rows, pieces in blocks for r, p in zip(rows, pieces, strict=True) if r == 0) == "abcdef" * 10


# -- language --------------------------------------------------------------------------------------------
def language_rows():
    rng = random.Random(1)
    parts = {"xx": ["ka", "tok", "ri", "sha"], "yy": ["le", "ment", "ou", "eau"], "zz": ["чт", "о", "на", "ст"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))
    return [(i, " ".join(word(lang) for _ in range(rng.randint(3, 60))), lang, None) for i, lang in enumerate(rng.choice(["xx", "yy", "zz"]) for _ in range(300))]


def test_language_of_held_out_texts(spark):
    rows = language_rows()
    model = langid.fit(spark.createDataFrame(rows[:200] + [(900, None, "xx", None), (901, "la", None, None)], DOCS), docs_per_lang=50)
    out = langid.predict(spark.createDataFrame(rows[200:], DOCS).repartition(3), model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = out.collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    again = langid.fit(spark.createDataFrame(rows[:200], DOCS).repartition(5), docs_per_lang=50)
    assert np.array_equal(model.log_prob, again.log_prob)


def test_sparse_scores_equal_counting_one_by_one(spark):
    model = langid.fit(spark.createDataFrame(language_rows()[:60], DOCS))
    texts = ["katok risha", "ОН ment eau", "", None, "le"]
    names, scores = langid.score_texts(model, texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        if not text:
            assert (name, score) == ("und", 0)
            continue
        total = model.log_prior.copy()
        for _, indptr, indices, counts in langid.sparse_counts([text], len(model.log_prob)):
            for i, c in zip(indices, counts, strict=True):
                total = total + c * model.log_prob[i].astype(float)
        p = np.exp(total - total.max())
        assert name == model.languages[int(p.argmax())] and abs(score - p.max() / p.sum()) < 1e-9


def test_grams_of_a_text_are_all_counted():
    text = "katok risha " * 400
    whole = np.zeros(1 << 12)
    for _, _, indices, counts in langid.sparse_counts([text], 1 << 12):
        np.add.at(whole, indices, counts)
    assert whole.sum() == 400 * 2 * (5 + 6 + 5)  # 1-, 2- and 3-grams of a word of five letters


@pytest.mark.parametrize("piece", [1, 2, 3, 50, 333])
def test_gram_counts_do_not_depend_on_pieces(piece):
    def counted(most):
        total = np.zeros((len(MIXED), 1 << 12))
        for rows, indptr, indices, counts in langid.sparse_counts(MIXED, 1 << 12, most):
            for i, row in enumerate(rows):
                np.add.at(total[row], indices[indptr[i] : indptr[i + 1]], counts[indptr[i] : indptr[i + 1]])
        return total

    assert np.array_equal(counted(1 << 17), counted(piece))


def test_too_many_languages_raise(spark):
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame([(i, "la", f"l{i}", None) for i in range(5)], DOCS), max_languages=4)


def test_odd_texts_and_no_training(spark):
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(ODD)], DOCS)
    nothing = langid.fit(df)
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}
    model = langid.fit(spark.createDataFrame(language_rows()[:30], DOCS))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und"] * 6 and got[11].lang_pred in ("xx", "yy", "zz")
    assert langid.predict(spark.createDataFrame([], DOCS), model).count() == 0


# -- quality -----------------------------------------------------------------------------------------------
def quality_rows(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgilmnoprstu") for _ in range(rng.randint(2, 8)))
    texts, labels = [], []
    for _ in range(n):
        lines = [" ".join(word() for _ in range(rng.randint(5, 25))).capitalize() + "." for _ in range(rng.randint(1, 8))]
        bad = rng.random() < 0.4
        if bad:
            junk = rng.choice([lambda: " | ".join(word() for _ in range(12)), lambda: "!! ".join(word().upper() for _ in range(12)), lambda: " ".join([word()] * 15)])
            lines[rng.randrange(len(lines)) :] = [junk() for _ in range(rng.randint(1, 4))]
        texts.append("\n".join(lines))
        labels.append(int(not bad))
    return texts, labels


def test_quality_on_held_out_documents():
    model = quality_crf.train(*quality_rows(1, 300))
    texts, labels = quality_rows(2, 200)
    score, good, lines = quality_crf.score_texts(model, texts)
    assert np.mean((score >= 0.5) == np.array(labels, dtype=bool)) > 0.95
    assert ((0 <= score) & (score <= 1)).all() and (good <= lines).all()


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    first = np.array([0, 1, 4, 4, 9])
    odds, transition = rng.normal(size=9), rng.normal(size=(2, 2))
    left, right = quality_crf.forward_backward(odds, first, transition)
    got = 1 / (1 + np.exp(-(left + right)))
    for a, b in zip(first[:-1], first[1:], strict=True):
        mass, total = np.zeros(b - a), 0.0
        for path in np.ndindex(*[2] * (b - a)):
            weight = np.exp(sum(o * y for o, y in zip(odds[a:b], path, strict=True)) + sum(transition[x, y] for x, y in zip(path, path[1:], strict=False)))
            total += weight
            mass += weight * np.array(path)
        assert np.allclose(got[a:b], mass / total)


def test_neighbouring_lines_are_features():
    model = quality_crf.train(*quality_rows(1, 100))
    first, bins, _ = quality_crf.line_features(["Good line here now.\n| | | |\nGood line here now."])
    alone = quality_crf.evidence(np.stack([model.weights[0], 0 * model.weights[1], 0 * model.weights[2]]), model.bias, first, bins)
    assert not np.allclose(alone, quality_crf.evidence(model.weights, model.bias, first, bins))


@pytest.mark.parametrize("piece", [1, 3, 20, 200])
def test_line_features_do_not_depend_on_pieces(piece):
    texts = [t or "" for t in MIXED] + quality_rows(4, 10)[0]
    for whole, cut in zip(quality_crf.line_features(texts), quality_crf.line_features(texts, piece), strict=True):
        assert np.array_equal(whole, cut)


def test_long_labelled_texts_are_drawn_whole(spark):
    rows = [("good text here. " * 5000, 1)] * 3 + [("bad | | bad", 0)] * 3
    texts, labels = fitting.draw(spark.createDataFrame(rows, "text string, y int"), "text", "y", 100, 10_000_000, 3)
    assert sorted(zip(texts, labels, strict=True)) == sorted(rows)
    few, _ = fitting.draw(spark.createDataFrame([(f"{i} " + "x" * 1000, i % 2) for i in range(400)], "text string, y int"), "text", "y", 400, 50_000, 3)
    assert 50 < len(few) < 160 and all(len(t) > 1000 for t in few)  # about 50 of each class
    with pytest.warns(UserWarning):
        fitting.draw(spark.createDataFrame([("a", 1)], "text string, y int"), "text", "y", 10, 100, 3)


def test_quality_of_odd_texts_in_spark(spark):
    model = quality_crf.train(*quality_rows(1, 100))
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate([*ODD, ODD[-1]])], DOCS)
    got = {r.doc_id: r for r in quality_crf.predict(df, model).collect()}
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in got.values()) and got[11].score == got[12].score
    assert got[0].score == got[1].score and got[0].lines == 0
    assert quality_crf.predict(df.limit(0), model).count() == 0
    one = quality_crf.train(["a", "b"], [1, 1])
    assert (quality_crf.score_texts(one, ["a", None])[0] > 0.9).all()
    assert (quality_crf.score_texts(quality_crf.train([], []), ["a"])[0] == 1).all() or quality_crf.score_texts(quality_crf.train([], []), ["a"])[0][0] > 0.99
    labelled = df.selectExpr("text", "CAST(doc_id % 2 AS INT) AS quality")
    assert isinstance(quality_crf.fit(labelled), quality_crf.QualityModel)


# -- toxicity ------------------------------------------------------------------------------------------------
def toxic_rows(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randint(2, 8)))
    texts, labels = [], []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(5, 150))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["frobnak", "zwixly", "quorvex"]))
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


@pytest.fixture(scope="module")
def toxic_model():
    return toxicity.train(*toxic_rows(1, 500))


def test_toxicity_on_held_out_texts(toxic_model):
    texts, labels = toxic_rows(2, 400)
    score, y = toxicity.score_texts(toxic_model, texts), np.array(labels, dtype=bool)
    assert (score[y] >= 0.7).mean() > 0.9 and (score[~y] >= 0.7).mean() < 0.02


def test_misspellings_share_grams(toxic_model):
    clean, variants = toxicity.score_texts(toxic_model, ["bad banana boat on the pond", "you frobnaak here today"])
    assert variants > clean + 0.3


def test_few_words_count_in_a_long_text(toxic_model):
    long = " ".join(toxic_rows(9, 1)[0] * 1) + " " + " ".join(t for t, k in zip(*toxic_rows(3, 120), strict=True) if not k)
    plain, with_word = toxicity.score_texts(toxic_model, [long, long + " frobnak zwixly quorvex frobnak"])
    assert with_word > 0.5 > plain or with_word > plain + 0.3


def test_folded_scalars_equal_averaged_vectors(toxic_model):
    owner, whole, layout = next(toxicity.text_words(["Frobnak the the THE zwixly"]))
    assert len(owner) == 3  # repeats count once
    of, bucket = toxicity.grams_of(layout, whole)
    word = np.bincount(of, weights=toxic_model.scalars[bucket]) / np.bincount(of)
    rows, mean = next(toxicity.window_logits(["Frobnak the the THE zwixly"], toxic_model.scalars, 2))
    assert np.allclose(mean, [(word[0] + word[1]) / 2, word[2]]) and list(rows) == [0, 0]


@pytest.mark.parametrize("piece", [1, 2, 7, 64])
def test_toxicity_does_not_depend_on_pieces(toxic_model, small_pieces, piece):
    texts = [*MIXED, *toxic_rows(5, 20)[0]]
    whole = toxicity.score_texts(toxic_model, texts)
    small_pieces(piece)
    assert np.allclose(whole, toxicity.score_texts(toxic_model, texts), atol=1e-12)


def test_toxicity_of_odd_texts_in_spark(spark, toxic_model):
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate([*ODD, ODD[-1]])], DOCS)
    got = {r.doc_id: r.score for r in toxicity.predict(df, toxic_model).collect()}
    assert len(got) == len(ODD) + 1 and all(0 <= s <= 1 for s in got.values())
    assert got[0] == got[1] == got[2] < 0.5 and got[11] == got[12]
    assert (toxicity.score_texts(toxicity.train(["a"], [1]), ["a", None]) == 0).all()
    assert (toxicity.score_texts(toxicity.train(["", "!"], [1, 0]), ["a", None]) == 0).all()


# -- SentencePiece -------------------------------------------------------------------------------------------
PATH = "/opt/tokenizers/piece_bpe_32k.model"
needs_model = pytest.mark.skipif(not os.path.exists(PATH), reason="no model file")
TEXTS = ["", " ", "  a  b ", "Hello world", "Is and retitioning the of, nterti", "\n\n x\t", "日本語 😀 abc", "x" * 700, "😀" * 300, "▁a ▁▁b", "tail  ", "Ñandú élan", " ".join(["word"] * 500), "<s> <0x41> </s>"]


@pytest.fixture(scope="module")
def model():
    return unigram.build(PATH)


def best_score(model, text):
    """Dynamic programming over all pieces, one by one."""
    pieces = {model.pieces[i]: model.score[i] for i in range(len(model.pieces)) if model.kinds[i] in (unigram.NORMAL, unigram.USER)}
    text = unigram.MARK + text.replace(unigram.MARK, "\0").replace(" ", unigram.MARK)  # no piece holds a zero
    best = [0.0] + [-np.inf] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + model.longest) + 1):
            if text[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[text[i:j]])
        if text[i] not in pieces:
            best[i + 1] = max(best[i + 1], best[i] + model.unknown)
    return best[-1]


@needs_model
def test_scores_are_the_best_possible(model):
    rng = random.Random(3)
    texts = [t for t in TEXTS if t] + ["".join(rng.choice("aeinorst lé\n▁") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    coder = unigram.Coder(model)
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        is_byte = coder.is_byte[ids]
        spelled = coder.byte_value[ids[is_byte]].tobytes().decode()
        assert sum(model.score[i] for i in ids[~is_byte]) + len(spelled) * model.unknown == pytest.approx(best_score(model, text), abs=1e-3), text


@needs_model
def test_agrees_with_the_library_lattice(tmp_path):
    spm = pytest.importorskip("sentencepiece")
    with open(PATH, "rb") as f:
        data = f.read()

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    scores = unigram.build(PATH).score
    out, i, piece = b"", 0, 0
    while i < len(data):  # the same file, marked as a unigram model, with log scores
        key, i = unigram._varint(data, i)
        n, i = unigram._varint(data, i)
        body, i = data[i : i + n], i + n
        if key >> 3 == 1:
            fields = dict(unigram._fields(body))
            body = b"\x0a" + varint(len(fields[1])) + fields[1] + b"\x15" + struct.pack("<f", scores[piece]) + b"\x18" + varint(fields.get(3, 1))
            piece += 1
        if key >> 3 == 2:
            at = 0
            while at < len(body):
                k, after = unigram._varint(body, at)
                if k == 3 << 3:
                    body = body[:after] + b"\x01" + body[after + 1 :]
                    break
                if k & 7 == 2:
                    size, after = unigram._varint(body, after)
                    at = after + size
                else:
                    at = unigram._varint(body, after)[1] if k & 7 == 0 else after + (4 if k & 7 == 5 else 8)
        out += varint(key) + varint(len(body)) + body
    path = tmp_path / "unigram.model"
    path.write_bytes(out)
    model = unigram.build(str(path))
    assert np.allclose(model.score, scores, atol=1e-5)  # a unigram model's scores are taken as they are
    library = spm.SentencePieceProcessor(model_proto=out)
    texts = ["Hello world", "the of and", "retitioning ouen", "élan vital", "a  b   c"]
    for text, ids in zip(texts, unigram.Coder(model).encode(texts), strict=True):
        theirs = library.nbest_encode_as_ids(text, 2)[0]
        assert ids.tolist() == library.encode(text)
        assert sum(model.score[i] for i in ids) == pytest.approx(sum(model.score[i] for i in theirs)), text


@needs_model
def test_round_trip_and_remembered_words(model):
    coder = unigram.Coder(model)
    first = [x.tolist() for x in coder.encode(TEXTS)]
    assert [coder.decode(np.array(x, dtype=np.int32)) for x in first] == TEXTS
    assert [x.tolist() for x in coder.encode(TEXTS)] == first
    assert [unigram.Coder(model).encode([t])[0].tolist() for t in TEXTS] == first


@needs_model
def test_scores_are_log_probabilities_and_words_stay_whole(model):
    used = [i for i, k in enumerate(model.kinds) if k == unigram.NORMAL]
    assert np.exp(model.score[used]).sum() == pytest.approx(1)
    ids = unigram.Coder(model).encode(["The quick brown fox jumps over the lazy dog"])[0]
    assert len(ids) == 11  # as many as by the model's own merges


@needs_model
@pytest.mark.parametrize("piece", [1, 2, 5, 40])
def test_coding_does_not_depend_on_pieces(model, small_pieces, piece, monkeypatch):
    texts = [t for t in [*TEXTS, *MIXED] if t is not None]
    whole = [x.tolist() for x in unigram.Coder(model).encode(texts)]
    small_pieces(piece)
    monkeypatch.setattr(unigram, "STRETCH", 97)
    coder = unigram.Coder(model)
    assert [x.tolist() for x in coder.encode(texts)] == whole and all(coder.code_long(t)[1] for t in texts)


@needs_model
def test_double_array_walks(model):
    for i in range(259, len(model.pieces), 97):
        state = 0
        for ch in model.pieces[i]:
            to = model.base[state] + model.alphabet[ord(ch)]
            assert model.check[to] == state
            state = to
        assert model.leaf[state] == i


@needs_model
def test_coding_in_spark(spark, model):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*TEXTS, None])], "doc_id bigint, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in unigram.encode_column(df, model).collect()}
    assert got[len(TEXTS)].ids is None and got[len(TEXTS)].round_trip is None
    assert all(got[i].round_trip and got[i].n_tokens == len(got[i].ids) for i in range(len(TEXTS))) and got[0].ids == []
    assert unigram.encode_column(df.limit(0), model).count() == 0


# -- very long texts -----------------------------------------------------------------------------------------
@needs_model
def test_ten_megabytes_in_one_text(model, toxic_model):
    """Each operator takes a text of 10 MB within some hundred MB, and gives what it should."""
    lines = ("Katok risha leme ntou, katok tok sha.\n" * 300 + "one more line here | with words\n") * 860
    assert len(lines) > 9_500_000
    bought = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    names, scores = langid.score_texts(langid.LanguageModel(["a", "b"], np.log([0.5, 0.5]), np.zeros((1 << 15, 2), np.float32)), [lines])
    assert names == ["a"] and scores[0] == pytest.approx(0.5)
    score, good, many = quality_crf.score_texts(quality_crf.train(*quality_rows(1, 60)), [lines, lines[:40_000]])
    assert many[0] == lines.count("\n") and good[0] <= many[0] and 0 <= score[0] <= 1
    coder = unigram.Coder(model)
    ids, same = coder.code_long(lines)
    assert same and coder.decode(np.frombuffer(ids, dtype=np.int32)) == lines
    assert toxicity.score_texts(toxic_model, [lines + " frobnak zwixly quorvex frobnak"])[0] > toxicity.score_texts(toxic_model, [lines])[0]
    hashes, ends = minhash.shingles([lines.encode()], 5)
    assert len(hashes) == ends[-1] == len(lines.split()) - 4
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - bought < 900_000  # KB
