import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

PASSAGE = "The quick brown fox jumps over the lazy dog while seven wise wizards mix a very potent brew of jade and quartz in the old town hall near the river. "
SECRET = 'token = "f0ddae3b09ae356cbefecdd3232fa5489bb400d6"'
CONTACT = "Write ann@example.com or call +1 (523) 555-1055, card 4111 1111 1111 1111, host 10.0.0.255."
TEXTS = {
    1: PASSAGE + "Something of its own follows here in plain words for all to read.",
    2: None,
    3: "",
    4: " \t\n ",
    5: PASSAGE * 2 + CONTACT,
    6: "Entirely other words make up this one and they share nothing with any text besides. " + SECRET,
    7: PASSAGE + "Something of its own follows here in plain words for all to read.",
    8: "line one is here\nline one is here\n" * 6,
    9: "ünïcödé Straße ΣΑΣ É é 日本語 İx a\x1cb <|endoftext|>  end  of   it\r\n#%&" + "x" * 120,
    10: " ".join(f"w{k % 700}" for k in range(9000)),
    11: "short",
    12: "x" * 99 + "y",
    13: "! a$ b% c# d& e* f| g< h> i# j$ k% l&",
    14: "Start " + PASSAGE[5:] + " tail words",
}


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def table(spark):
    """Rows (doc_id, text) with more columns whose names clash with results."""

    def make(rows):
        wide = [(i, t, None, 1, "z", "q") for i, t in rows]
        return spark.createDataFrame(wide, "doc_id bigint, text string, n_tokens string, kg int, component_id string, `a.b` string")

    return make


@pytest.fixture(scope="session")
def docs(table, texts):
    return table(list(texts.items()))


@pytest.fixture(scope="session")
def rowless(table):
    return table([])
