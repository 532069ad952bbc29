"""Texts of the command line in English and Japanese."""

from __future__ import annotations

import os

#: Environment variable that names the locale where none is given.
LOCALE_VARIABLE = "CHATLAKE_LOCALE"

CATALOGS = {
    "en": {
        "description": "Turn exported conversations into threads and Markdown.",
        "parse": "read exports and write threads",
        "export": "write Markdown of threads",
        "chain": "parse, then export",
        "provider": "provider of the export",
        "input": "export file or folder",
        "outdir": "where results go",
        "dry_run": "write nothing",
        "fail_fast": "stop at errors",
        "split": "size=4M, count=1500 or auto",
        "tz": "time zone of headings",
        "formatting": "none or light",
        "parsed": "{threads} threads, {messages} messages, {errors} errors, {skipped} skipped",
        "exported": "{files} files, {errors} errors",
        "unknown_tz": "unknown time zone {tz}; UTC is used",
        "missing": "no such path: {path}",
        "viewer": "not available yet",
    },
    "ja": {
        "description": "エクスポートした会話をスレッドと Markdown に変換します。",
        "parse": "エクスポートを読み、スレッドを書き出す",
        "export": "スレッドを Markdown に書き出す",
        "chain": "解析して書き出す",
        "provider": "エクスポートの提供元",
        "input": "エクスポートのファイルまたはフォルダ",
        "outdir": "出力先",
        "dry_run": "何も書き込まない",
        "fail_fast": "エラーで停止する",
        "parsed": "スレッド {threads} 件、メッセージ {messages} 件、エラー {errors} 件、スキップ {skipped} 件",
        "exported": "ファイル {files} 件、エラー {errors} 件",
        "unknown_tz": "タイムゾーン {tz} は不明です。UTC を使います",
        "missing": "パスがありません: {path}",
    },
}

_current = "en"


def normalize(name: str | None) -> str:
    """A known locale: ``ja_JP`` and ``ja-JP`` are ``ja``; unknown ones are ``en``."""
    short = (name or "").replace("_", "-").split("-")[0].split(".")[0].lower()
    return short if short in CATALOGS else "en"


def resolve(given: str | None = None) -> str:
    return normalize(given or os.environ.get(LOCALE_VARIABLE) or "en")


def set_locale(name: str | None) -> str:
    global _current
    _current = resolve(name)
    return _current


def t(key: str, locale: str | None = None, **values) -> str:
    """Text of ``key``: in the locale, else in English, else the key; values that do not fit are left out."""
    text = CATALOGS[normalize(locale) if locale else _current].get(key) or CATALOGS["en"].get(key) or key
    try:
        return text.format(**values)
    except (KeyError, IndexError, ValueError):
        return text
