"""Names of library methods: a call of one, on a receiver whose type is not known, may lead outside the worktree."""

from __future__ import annotations

import array
import collections
import concurrent.futures
import configparser
import csv
import ctypes
import datetime
import decimal
import email.message
import enum
import fractions
import http.client
import io
import json
import logging
import pathlib
import queue
import re
import socket
import string
import struct
import subprocess
import tempfile
import threading
import types
import uuid
import zipfile

#: Modules of Python's library whose types' methods count beside those of the built-in types.
MODULES = (array, collections, concurrent.futures, configparser, csv, ctypes, datetime, decimal, email.message, enum, fractions, http.client, io, json, logging, pathlib, queue, re, socket, string, struct, subprocess, tempfile, threading, types, uuid, zipfile)


def python_methods() -> list[str]:
    """Names of methods that the types of the running Python's library have, dunders aside."""
    found = [t for t in vars(__builtins__ if isinstance(__builtins__, types.ModuleType) else types.SimpleNamespace(**__builtins__)).values() if isinstance(t, type)]
    found += [t for m in MODULES for t in vars(m).values() if isinstance(t, type)]
    return sorted({n for t in found for n in dir(t) if not n.startswith("_") and callable(getattr(t, n, None))})


# Methods that Rust's standard types are most often called by. A fuller list may be given to `edges.resolved`.
RUST_METHODS = (
    "all", "and_then", "any", "append", "as_bytes", "as_deref", "as_mut", "as_ptr", "as_ref", "as_slice", "as_str", "borrow", "borrow_mut", "by_ref", "bytes", "capacity", "chain", "chars", "checked_add", "checked_sub",
    "chunks", "clear", "clone", "cloned", "cmp", "collect", "concat", "contains", "contains_key", "copied", "count", "cycle", "dedup", "display", "drain", "end", "ends_with", "entry", "enumerate", "eq",
    "err", "exists", "expect", "extend", "file_name", "fill", "filter", "filter_map", "find", "find_map", "first", "flat_map", "flatten", "flush", "fold", "for_each", "fmt", "get", "get_mut", "get_or_insert_with",
    "hash", "insert", "into", "into_inner", "into_iter", "is_dir", "is_empty", "is_err", "is_file", "is_none", "is_ok", "is_some", "is_some_and", "iter", "iter_mut", "join", "keys", "last", "len", "lines",
    "load", "lock", "map", "map_err", "map_or", "max", "max_by_key", "min", "min_by_key", "next", "ne", "nth", "ok", "ok_or", "ok_or_else", "or_default", "or_else", "or_insert", "or_insert_with", "parent",
    "parse", "partial_cmp", "partition", "peek", "peekable", "pop", "position", "product", "push", "push_back", "push_str", "read", "read_line", "read_to_end", "read_to_string", "recv", "remove", "repeat", "replace", "reserve",
    "resize", "retain", "rev", "reverse", "rposition", "rsplit", "scan", "send", "set", "skip", "skip_while", "sort", "sort_by", "sort_by_key", "sort_unstable", "spawn", "split", "split_at", "split_off", "split_whitespace", "splitn",
    "start", "starts_with", "status", "step_by", "store", "strip_prefix", "strip_suffix", "sum", "swap", "take", "take_while", "then", "then_some", "to_lowercase", "to_owned", "to_path_buf", "to_string", "to_uppercase", "to_vec", "trim", "trim_end",
    "trim_start", "truncate", "try_into", "unwrap", "unwrap_or", "unwrap_or_default", "unwrap_or_else", "values", "values_mut", "wait", "windows", "with_capacity", "wrapping_add", "write", "write_all", "zip",
)

METHODS: dict[str, list[str]] = {"python": python_methods(), "rust": list(RUST_METHODS)}
