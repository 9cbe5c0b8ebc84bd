"""Operators for preparing training corpora: mixing, sharding, search, duplicates, chats, filters and tokens."""
