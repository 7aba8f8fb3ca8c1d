"""What the encoders of pieces remember."""

from evidora.llm import bpe


def test_the_pieces_of_a_task_are_encoded_once():
    calls = [0]

    def encode(piece):
        calls[0] += 1
        return [len(piece), 7]

    texts = [" ".join(f"word{chr(97 + k)}" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(20_000)) for k in range(12)]
    codec = bpe.PieceCodec(encode)
    first = [codec.encode([t])[0].tolist() for t in texts]
    once = calls[0]
    assert once == 12 * 20_000 == sum(len(x) for x in first) // 2
    assert [codec.encode([t])[0].tolist() for t in texts] == first
    assert calls[0] == once
    assert codec.known.size <= bpe.PIECE_BYTES
