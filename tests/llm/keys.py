"""Made keys of known places, and texts without any, for measuring operator 10."""

from random import Random

CLEAN = """
https://docs.python.org/3/library/concurrent.futures.html#module-concurrent.futures.thread
see /usr/local/share/applications/settings-manager/default-profile/theme_dark_blue
getUserAccountBalanceFromCachedSession and setDefaultConnectionTimeoutMillis
Donaudampfschifffahrtsgesellschaftskapitaen und Kraftfahrzeughaftpflichtversicherung
550e8400-e29b-41d4-a716-446655440000 and users/123e4567-e89b-12d3-a456-426614174000/home
sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU= is a digest
2024-01-01/2024-12-31/0001 2023-11-04 1234567890123456789012345
YOUR_API_TOKEN_GOES_HERE_PLEASE your-secret-key-placeholder-value xxxxxxxxxxxxxxxxxxxxxxxxxx
internationalization-and-localization-guidelines-for-translators
com/example/project/src/main/java/HttpServletRequestWrapper
THIS_IS_A_VERY_LONG_CONSTANT_NAME_IN_UPPER_CASE
==================== -------------------- ++++++++++++++++++++
AbstractSingletonProxyFactoryBean InternalFrameInternalFrameTitlePaneMaximizeWindow
antidisestablishmentarianism pneumonoultramicroscopicsilicovolcanoconiosis
en-US/firefox/addon/privacy-badger17/reviews/page-2
""".strip().split("\n")
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
FAMILIES = {"mixed": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "letters": UPPER + LOWER, "upper": UPPER + DIGITS, "lower": LOWER + DIGITS, "hexadecimal": DIGITS + "ABCDEF"}


def keys(family, n, seed=1):
    """Texts with one key, and the key's place."""
    r = Random(seed)
    for _ in range(n):
        key = "".join(r.choice(FAMILIES[family]) for _ in range(r.choice([20, 24, 32, 40, 64])))
        head = r.choice(["use ", "key: ", "Authorization Bearer ", "(", "https://api.host.net/v1/", "example/"])
        yield f"{head}{key} now", len(head), len(head) + len(key)
