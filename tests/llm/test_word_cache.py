"""The word cache stays within its two generations and gives the ids of whole texts."""

import public_tokenizers

from vantage.llm import packing


def test_generations_bound_the_cache():
    cache = packing.WordCache(public_tokenizers.path("word_bpe_49k.json"), 50, keep_older=True)
    texts = [f"common words stay, {i}x word{i} and q{i % 7}.\nNext line" for i in range(400)]
    want = [e.ids for e in cache.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [ids.tolist() for t in texts for ids in cache.encode([t])]
    assert got == want
    assert len(cache.ids) + len(cache.older) < 3 * 50
    assert "common" in cache.ids or "common" in cache.older
