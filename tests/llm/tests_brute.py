"""Plain versions that tests compare with."""


def shingle_sets_link(rows: list[tuple[int, str]], words: int, percent: int) -> list[int]:
    """Least ids of the groups that links of word-shingle sets make."""
    sets = []
    for _, t in rows:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)
