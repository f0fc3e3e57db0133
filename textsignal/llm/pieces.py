"""The piece vocabulary of a SentencePiece model file, read once per Python worker."""

from __future__ import annotations

import functools
import re

SPACE = "▁"


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Scores and ids of the ordinary pieces, and the ids of the 256 byte pieces."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(len(sp))]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)
        self.ids = {p: i for i, p in enumerate(self.names) if not skip(i)}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.alphabet = {c for p in self.ids for c in p}
        self.segments = re.compile(self._stretch())

    def _stretch(self) -> str:
        """A pattern that cuts a text only where no piece continues: before spaces that follow another
        character, around line feeds, and after a Latin letter that none
        follows.  Each kind of cut is
        used only if the vocabulary really has no piece across it."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return r"(?s).+"
        if "\n" in self.alphabet:
            return r" *+[^ ]++| ++"
        latin = "A-Za-zÀ-ɏ"
        if any(re.search(rf"[{latin}][^{latin}]", p) for p in self.ids):
            return r" *+[^ \n]++| ++|\n"
        return rf" *+[^ \n{latin}]*+[{latin}]++| *+[^ \n{latin}]++| ++|\n"


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)
