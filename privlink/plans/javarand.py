"""The linear congruential generator that java.util.Random documents, for seeds that both parties must share."""

from __future__ import annotations

# Fixed values of the published generator.
MULTIPLIER, INCREMENT, MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1


class JavaRandom:
    def __init__(self, seed: int):
        self.state = (seed ^ MULTIPLIER) & MASK

    def bits(self, n: int) -> int:
        """The next n bits as a signed 32-bit integer."""
        self.state = (self.state * MULTIPLIER + INCREMENT) & MASK
        x = self.state >> (48 - n)
        return x - (1 << 32) if n == 32 and x >> 31 else x

    def below(self, bound: int) -> int:
        """Uniform over 0 .. bound - 1; draws again where the last, incomplete stretch of 31-bit numbers is hit."""
        if bound <= 0:
            raise ValueError("bound must be positive")
        if bound & (bound - 1) == 0:
            return (bound * self.bits(31)) >> 31
        while True:
            x = self.bits(31)
            if x - x % bound + bound - 1 < 1 << 31:
                return x % bound


def permutation(n: int, seed: int) -> list[int]:
    """0 .. n-1 shuffled from the back, each place swapped with a random one up to it."""
    random, out = JavaRandom(seed), list(range(n))
    for last in range(n - 1, 0, -1):
        k = random.below(last + 1)
        out[last], out[k] = out[k], out[last]
    return out


def draws(count: int, bound: int, seed: int) -> list[int]:
    """``count`` numbers below ``bound``, with replacement."""
    random = JavaRandom(seed)
    return [random.below(bound) for _ in range(count)]
