"""Replays seeded shuffles of numpy's legacy generator without holding what is shuffled."""

import numpy as np

STEPS = 1 << 20


def _below(generator, top, count):
    """The next ``count`` draws of a shuffle, whose bounds are ``top``, ``top`` - 1, …

    A draw takes raw numbers, cut to the bits of its bound, until one is not above it.
    """
    found = []
    while count:
        mask = (1 << int(top).bit_length()) - 1
        # Draws with the same mask can be tried together.
        wanted = min(count, top - (mask >> 1))
        if mask <= 0xFFFFFFFF:
            raw = generator.randint(0, 1 << 32, wanted, np.uint32).astype(np.int64) & mask
        else:
            pairs = generator.randint(0, 1 << 32, 2 * wanted, np.uint32).astype(np.int64)
            raw = ((pairs[::2] << 32) | pairs[1::2]) & mask
        accepted = raw <= top
        while True:  # each bound depends on how many draws before were accepted
            earlier = np.cumsum(accepted) - accepted
            again = raw <= top - earlier
            if (again == accepted).all():
                break
            accepted = again
        draws = raw[accepted]
        found.append(draws)
        top, count = top - len(draws), count - len(draws)
    return np.concatenate(found) if found else np.array([], np.int64)


def first_of_shuffle(size, seed):
    """What a seeded shuffle of 0 to ``size`` - 1 leaves in front.

    The shuffle swaps each place, from the last one down to 1, with a drawn one before it or
    itself. What ends up in front was at place p when place p was swapped with it; it had got
    there in the swap of a later place, and so on up. Draws come from the last place down but
    are followed up from the first one, so the generator's state is kept for every STEPS
    draws and these are drawn again: memory is bounded, whatever the size.
    """
    generator, states, top = np.random.RandomState(seed), [], size - 1
    while top > 0:
        count = min(STEPS, top)
        states.append((generator.get_state(), top, count))
        if top > count:
            _below(generator, top, count)
        top -= count
    place = 0
    for state, top, count in reversed(states):
        generator.set_state(state)
        drawn = _below(generator, top, count)[::-1]  # of places top - count + 1 to top
        low = top - count + 1
        while len(found := np.flatnonzero(drawn[max(0, place + 1 - low) :] == place)):
            place = max(low, place + 1) + int(found[0])
    return place
