"""Operators of a training-data pipeline over documents and conversations.

Nothing else in the library imports this subpackage; it imports only the shared
work-folder helpers of ``tokentide.session``.
"""
