"""Written intermediate tables in the folder that the cluster shares: the library's own, under the name that this subpackage's modules use."""

from ..scratch import cleanup, drop, numbered, root, written  # noqa: F401
