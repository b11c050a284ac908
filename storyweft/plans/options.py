"""Options of a run: standard ones, those of a model, and the caller's, later ones winning."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

ALIASES = {"sbert_nli_sts": "sbert"}


@dataclass(frozen=True)
class Options:
    model: str = "tfidf_dataset"
    dataset: str = "data"
    annotation: str = "no"
    lang: str = "fr"
    threshold: tuple[float, ...] = (0.65,)
    batch_size: int = 8
    window: float = 24.0
    hashtag_split: bool = True
    remove_mentions: bool | None = None
    svd: bool = False
    binary: bool = True
    tfidf_weights: bool = False
    text_plus: bool = False
    sub_model: str | None = None
    min_df: int = 10
    save: bool = True
    save_results: bool = True


def _fields(given: dict) -> dict:
    given = {("text_plus" if k == "text+" else k): v for k, v in given.items()}
    known = {f.name for f in fields(Options)}
    if "threshold" in given and given["threshold"] is not None:
        t = given["threshold"]
        given["threshold"] = tuple(t) if isinstance(t, list | tuple) else (t,)
    return {k: v for k, v in given.items() if k in known and v is not None}


def merged(model: str, document: dict, given: dict | None = None) -> Options:
    """Options of one model from a document with a ``standard`` block and a block per model; a model
    starts from the standard ones, so nothing leaks from one model to the next."""
    out = replace(Options(), **_fields(document.get("standard", {})))
    out = replace(out, **_fields(document.get(model, {})))
    return replace(out, **_fields(given or {}), model=ALIASES.get(model, model))


#: How texts are cleaned for a model: mentions removed if asked; ASCII and lower case for tf-idf and
#: French word vectors, the words' own letters and case for English ones and encoders.
def cleaning(options: Options) -> dict:
    mentions = bool(options.remove_mentions)
    if options.model.startswith("tfidf") or (options.model.startswith("w2v") and options.lang == "fr"):
        return {"remove_mention": mentions, "ascii_only": True, "lower": True, "hashtag_split": options.hashtag_split}
    if options.model.startswith("w2v"):
        mentions = mentions and options.model != "w2v_twitter_en"
        return {"remove_mention": mentions, "ascii_only": False, "lower": False, "hashtag_split": options.hashtag_split}
    return {"remove_mention": mentions, "ascii_only": False, "lower": False, "hashtag_split": True}
