import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from nestkit.llm.pieces import BPE, DEFAULT_MODEL, UNIGRAM, Pieces
from nestkit.llm.sentencepiece_codec import Codec, encode, encode_columns
from nestkit.llm.token_counts import Counter, count_tokens

from .cases import LONG, ROWS, documents, empty


def texts(n=1500):
    rng = random.Random(7)
    alphabet = " ▁  \n\tabcdeITHEtheing.,0123é日本語한국😀'\"<>\\x{}()`=_-\x00"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    out += [" " * k for k in range(40)] + ["a" + " " * k + "b" for k in range(40)] + ["a" * k for k in range(60)]
    return out + ["".join(rng.choice("abeinrstTH ") for _ in range(40)) for _ in range(n)] + [r[1] or "" for r in ROWS]


def unigram(fallback, seed=3):
    """A unigram model made by hand, with scores on a coarse grid so that ties are common."""
    rng = random.Random(seed)
    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = UNIGRAM, fallback
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=piece, score=0, type=kind)
    if fallback:
        for b in range(256):
            m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    seen = set("▁abeinrstTH")
    while len(seen) < 400:
        seen.add(rng.choice(["▁", "", ""]) + "".join(rng.choice("abeinrstTH") for _ in range(rng.randint(2, 6))))
    for piece in sorted(seen - {"T"}):
        m.pieces.add(piece=piece, score=-rng.randint(4, 20) / 2, type=1)
    return m


@pytest.fixture(scope="module")
def model():
    with open(DEFAULT_MODEL, "rb") as f:
        return pb.ModelProto.FromString(f.read())


def compare(proto, cases):
    pieces, library = Pieces.from_proto(proto), sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    codec, counter = Codec(pieces), Counter(pieces)
    ids, at = codec.encode(cases)
    want = library.encode(cases)
    for i, (t, w) in enumerate(zip(cases, want)):
        assert ids[at[i] : at[i + 1]].tolist() == w, t
        assert counter.count(t) == len(w), t
    assert codec.decode(ids, at) == library.decode(want)


def test_bpe_file_equals_the_library(model):
    assert model.trainer_spec.model_type == BPE
    compare(model, texts())


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_file_equals_the_library(fallback):
    rng = random.Random(1)
    cases = ["".join(rng.choice("abeinrstTH ") for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["TTTa", "aéé b", "", " "]
    compare(unigram(fallback), cases)


def test_round_trip_and_reset(model, monkeypatch):
    from nestkit.llm import sentencepiece_codec as module

    monkeypatch.setattr(module, "REMEMBERED", 5)
    codec = Codec(Pieces.from_proto(model))
    for batch in (texts(50), [LONG, "again", LONG], []):
        cases = [t.replace("▁", "_") for t in batch]
        ids, at = codec.encode(cases)
        assert codec.decode(ids, at) == cases


def test_text_without_spaces(model):
    """Lines of many lengths advance together, and characters of no longer piece are words of their own."""
    import time

    rng = random.Random(4)
    lines = ["".join(rng.choice("的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后小么心多天而能好都然没日于起还发成事只作当想看文无开手十用主行方又如前所本见经头面公同三已老从动两长知民样现分将外但身些与高意进把法此实回二理美点月明其种声全工己话儿者向情部正名定女问力机给等几很业最间新什打便位因重被走电四第门相次东政海口使教西再平真听世气信北少关并内加化由却代军产入先山五太水万市眼体别处总才场师书比住员九笑性通目华报立马命张活难神数件安表原车白应路期叫死常提感金何更反合放做系计或司利受光王果亲界及今京务制解各任至清物台象记边共风战干接它许八特觉望直服毛林题建南度统色字请交爱让认算论百吃义科怎元社术结六功指思非流每青管夫连远资队跟带花快条院变联言权往展该领传近留红治决周保达办运武半候七必城父强步完革深区即求品士转量空甚众技轻程告江语英基派满式李息写呢识极令黄德收脸钱党倒未持取设始版双历越史商千片容研像找友孩站广改议形委早房音火际则首单据导影失拿网香似斯专石若兵弟谁校读志飞观争究包组造落视济喜离虽坏兴切际。，") for _ in range(rng.randint(3, 90))) for _ in range(3000)]
    codec, counter = Codec(Pieces.from_proto(model)), Counter(Pieces.from_proto(model))
    began = time.time()
    ids, at = codec.encode(lines)
    took, began = time.time() - began, time.time()
    counts = [counter.count(t) for t in lines]
    counted = time.time() - began
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()).encode(lines)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library and counts == [len(x) for x in library]
    assert took < 3 * counted + 0.5 and took / sum(len(t.encode()) for t in lines) < 900e-9
    kana = ["".join(rng.choice("あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほアイウエオเดกนมabcé") for _ in range(rng.randint(1, 70))) for _ in range(500)]
    compare(model, kana)


def test_pieces_pickle_without_cache(model):
    import pickle

    pieces = Pieces.from_proto(model)
    pieces.beside(np.array([300]), np.array([301]))
    assert pickle.loads(pickle.dumps(pieces)).cache_keys is None


def test_other_normalisers_are_refused(model):
    other = pb.ModelProto.FromString(model.SerializeToString())
    other.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        Pieces.from_proto(other)


def test_frames(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    want = sorted([(r[0], library.encode(r[1] or ""), r[1] or "") for r in ROWS], key=str)
    frame = documents(spark)
    got = encode(frame, decode=True)
    assert sorted([(r.doc_id, r.ids, r.decoded) for r in got.collect()], key=str) == want
    assert all(r.n_tokens == len(r.ids) for r in got.collect())
    wide = encode_columns(frame)
    assert wide.columns == [*frame.columns, "_n_tokens", "_ids"] and {r.ids for r in wide.collect()} == {"extra"}
    assert sorted([(r.doc_id, r._ids, r.text or "") for r in wide.collect()], key=str) == want
    assert sorted([(r.doc_id, r.n_tokens) for r in count_tokens(frame).collect()], key=str) == sorted([(i, len(x)) for i, x, _ in want], key=str)
    assert encode(empty(spark)).count() == 0 and count_tokens(empty(spark)).count() == 0 and encode_columns(empty(spark)).count() == 0
