import random

WORDS = [a + b for a in ("ta", "re", "mi", "so", "lu", "ke", "no") for b in ("", "n", "st", "rd", "la", "vo", "pe", "qua")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def odd_texts():
    """Nulls, empty, white space only, one word, very long, repeated words, other scripts."""
    return [None, "", " \t\n ", "word", "word", prose(1, 30), prose(1, 30), prose(2, 20_000), "ta " * 500, "é 漢字 😀 x", "<|endoftext|>  a   b \n\n c"]
