"""Expressions over paths, sizes, identities and HTTP headers."""

from __future__ import annotations

import mimetypes
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories by extension, the first that has it.
CATEGORIES = {
    "文档": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "md", "rtf", "csv"),
    "图片": ("jpg", "jpeg", "png", "gif", "webp", "bmp", "heic", "tif", "tiff", "svg"),
    "音频": ("mp3", "wav", "m4a", "flac", "aac", "ogg"),
    "视频": ("mp4", "mkv", "mov", "avi", "wmv", "webm", "flv", "ts"),
    "压缩包": ("zip", "rar", "7z", "tar", "gz", "bz2"),
    "代码": ("py", "js", "ts", "java", "c", "cpp", "go", "rs", "sh", "bat", "ps1", "json", "yaml", "yml", "toml", "xml", "html", "css"),
    "软件": ("iso", "exe", "msi", "apk", "dmg"),
}
OTHER = "其他"
#: What a file of an extension is.
MEANINGS = {
    "py": "Python 源代码", "pyw": "Python 脚本", "pyc": "Python 字节码缓存", "js": "JavaScript 脚本", "mjs": "JavaScript 模块", "cjs": "JavaScript 脚本",
    "ts": "TypeScript 源代码", "jsx": "React JSX 源码", "tsx": "React TSX 源码", "java": "Java 源代码", "class": "Java 字节码", "jar": "Java 程序包",
    "c": "C 源代码", "h": "C 头文件", "cpp": "C++ 源代码", "hpp": "C++ 头文件", "cs": "C# 源代码", "go": "Go 源代码", "rs": "Rust 源代码",
    "sh": "Shell 脚本", "bash": "Bash 脚本", "bat": "Windows 批处理脚本", "cmd": "Windows 命令脚本", "ps1": "PowerShell 脚本", "vue": "Vue 组件源码",
    "php": "PHP 源代码", "rb": "Ruby 源代码", "swift": "Swift 源代码", "kt": "Kotlin 源代码", "lua": "Lua 脚本", "pl": "Perl 脚本", "r": "R 脚本",
    "m": "MATLAB/Objective-C 源码", "sql": "SQL 脚本", "ipynb": "Jupyter 笔记本", "csproj": ".NET 工程文件", "sln": "Visual Studio 解决方案",
    "vcxproj": "Visual C++ 工程文件", "xcodeproj": "Xcode 工程目录", "iml": "IntelliJ 模块文件", "gradle": "Gradle 构建脚本", "groovy": "Groovy 脚本",
    "dart": "Dart 源代码", "scala": "Scala 源代码", "hs": "Haskell 源代码", "ex": "Elixir 源代码", "erl": "Erlang 源代码", "clj": "Clojure 源代码",
    "asm": "汇编源码", "s": "汇编源码", "f": "Fortran 源代码", "vb": "Visual Basic 源代码",
    "yaml": "YAML 配置文件", "yml": "YAML 配置文件", "xml": "XML 文件", "toml": "TOML 配置文件", "ini": "配置文件", "cfg": "配置文件", "conf": "配置文件",
    "properties": "Java 属性配置", "db": "数据库文件", "sqlite": "SQLite 数据库", "sqlite3": "SQLite 数据库", "dbf": "dBase 数据库文件",
    "geojson": "GeoJSON 地理数据", "lock": "依赖锁文件", "map": "sourcemap 映射文件", "tsbuildinfo": "TypeScript 构建缓存", "pdb": "程序调试符号文件",
    "html": "网页文件", "htm": "网页文件", "css": "CSS 样式表", "scss": "SCSS 样式源码", "less": "LESS 样式源码", "sass": "Sass 样式源码",
    "exe": "Windows 可执行程序", "dll": "Windows 动态链接库", "msi": "Windows 安装包", "iso": "光盘镜像文件", "apk": "Android 安装包", "ipa": "iOS 应用包",
    "dmg": "macOS 磁盘镜像", "pkg": "安装包文件", "deb": "Debian 软件包", "rpm": "RPM 软件包", "so": "Linux 共享库", "dylib": "macOS 动态库",
    "a": "静态库文件", "o": "编译目标文件", "obj": "编译目标文件", "wasm": "WebAssembly 模块", "whl": "Python wheel 安装包", "egg": "Python egg 包",
    "sys": "系统驱动文件", "drv": "驱动程序文件", "nupkg": "NuGet 软件包", "gem": "Ruby 软件包", "crate": "Rust 软件包",
    "zip": "ZIP 压缩包", "rar": "RAR 压缩包", "7z": "7-Zip 压缩包", "tar": "tar 打包文件", "gz": "gzip 压缩文件", "bz2": "bzip2 压缩文件", "xz": "xz 压缩文件",
    "zst": "zstd 压缩文件",
    "psd": "Photoshop 源文件", "ai": "Adobe Illustrator 文件", "svg": "SVG 矢量图", "eps": "EPS 矢量图", "fig": "Figma 设计文件", "sketch": "Sketch 设计文件",
    "xmind": "XMind 思维导图", "mm": "FreeMind 思维导图", "ppt": "老版 PowerPoint 演示文稿", "wps": "WPS 文字文档", "et": "WPS 表格文档",
    "msg": "Outlook 邮件文件", "eml": "邮件文件", "odt": "OpenDocument 文档", "ods": "OpenDocument 表格", "odp": "OpenDocument 演示",
    "ttf": "字体文件", "otf": "字体文件", "woff": "Web 字体", "woff2": "Web 字体", "tmp": "临时文件", "bak": "备份文件", "old": "旧版本文件",
    "patch": "补丁文件", "diff": "差异补丁文件", "po": "翻译文件", "mo": "编译后的翻译文件", "swf": "Flash 动画", "fla": "Flash 源文件",
    "part": "未完成下载的临时文件", "crdownload": "浏览器未完成下载文件", "lnk": "快捷方式文件", "url": "网址快捷方式", "torrent": "BT 种子文件",
}
#: What well-known files without a listed extension are, by name in lower case.
NAME_MEANINGS = {
    "dockerfile": "Docker 容器构建文件", "makefile": "Make 构建脚本", "cmakelists.txt": "CMake 构建配置", "license": "许可证文本", "copying": "许可证文本",
    "readme": "说明文档", "changelog": "变更日志", "go.mod": "Go 模块定义", "go.sum": "Go 依赖校验文件", "gemfile": "Ruby 依赖清单",
    "gemfile.lock": "Ruby 依赖锁文件", "vagrantfile": "Vagrant 虚拟机配置", "procfile": "进程声明文件", "cargo.lock": "Rust 依赖锁文件",
    "yarn.lock": "yarn 依赖锁文件", "pnpm-lock.yaml": "pnpm 依赖锁文件", "poetry.lock": "Poetry 依赖锁文件", "composer.lock": "Composer 依赖锁文件",
    "pipfile": "Python 依赖声明（Pipenv）", "pipfile.lock": "Python 依赖锁文件（Pipenv）", ".env": "环境变量配置文件", ".gitignore": "Git 忽略规则文件",
    ".gitattributes": "Git 属性文件", ".gitmodules": "Git 子模块定义", ".dockerignore": "Docker 构建忽略规则", ".editorconfig": "编辑器风格配置",
    ".prettierrc": "Prettier 格式化配置", ".babelrc": "Babel 转译配置", ".npmrc": "npm 配置", ".eslintrc": "ESLint 配置", ".flake8": "flake8 配置",
    ".pylintrc": "pylint 配置", ".htaccess": "Apache 服务器配置", ".vimrc": "Vim 配置", ".bashrc": "Bash 配置", ".zshrc": "zsh 配置",
    ".gitconfig": "Git 全局配置", "terraform.lock.hcl": "Terraform 依赖锁文件",
}
#: Types whose content is analysed, system files, and folders that a walk leaves out (names in lower case).
SUPPORTED = (
    "txt", "md", "pdf", "docx", "xlsx", "pptx", "doc", "xls", "km", "mmap", "csv", "json", "rtf",
    "jpg", "jpeg", "png", "gif", "bmp", "webp", "tif", "tiff", "heic", "avif",
    "mp3", "wav", "m4a", "flac", "aac", "ogg", "wma", "amr", "opus",
    "mp4", "mkv", "avi", "mov", "wmv", "flv", "ts", "m4v", "webm", "mpg", "mpeg", "rmvb", "3gp",
)
SYSTEM_FILES = ("thumbs.db", ".ds_store", "desktop.ini", ".localized", ".directory", "ehthumbs.db", ".thumbnails", ".fseventsd", ".spotlight-v100")
WALK_SYSTEM_FILES = ("desktop.ini", "thumbs.db", ".ds_store", ".localized")
WALK_EXCLUDED = ("$recycle.bin", "system volume information", "#recycle")
#: What a browser shows of an extension.
VIEWS = {
    "image": ("jpg", "jpeg", "png", "gif", "webp", "bmp", "svg", "ico"),
    "video": ("mp4", "webm", "m4v", "ogv"),
    "audio": ("mp3", "wav", "m4a", "flac", "aac", "ogg", "oga", "opus"),
    "pdf": ("pdf",),
    "text": (
        "txt", "md", "markdown", "json", "xml", "yml", "yaml", "toml", "ini", "csv", "log", "py", "js", "ts", "css", "html", "htm",
        "c", "h", "cpp", "java", "go", "rs", "sh", "bat", "ps1", "sql", "conf",
    ),
    "office": ("docx", "xlsx", "pptx"),
}
#: Words in the names of pictures that are likely documents.
DOCUMENT_WORDS = (
    "发票", "票据", "收据", "证书", "证件", "身份证", "护照", "行驶证", "驾照", "营业执照", "合同", "协议", "报告", "体检", "病历", "处方", "保单", "缴费", "账单",
    "工资", "流水", "对账", "回执", "录取", "通知", "证明", "房产", "产权", "学位", "毕业", "invoice", "receipt", "certificate", "contract", "ticket", "bill",
)
#: Categories of videos by words in the name: (category, words, mode).
VIDEO_WORDS = (
    ("媒体/影视/电影", ("电影", "movie", "BluRay", "1080p"), "metadata_only"),
    ("媒体/影视/剧集", ("剧集", "season", "s01", "第1季", "TV"), "metadata_only"),
    ("媒体/教学视频", ("教程", "课程", "教学", "lecture", "course"), "keyframes_only"),
)
SPAN, SAMPLES, WHOLE = 64 * 1024, 8, 512 * 1024
FULL, SAMPLED = "sha256:full", "sha256:sample8x64k"


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), "^.+\\.([^.]+)$", 1))


def depth_of(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def normalised(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "^(\\./)+", ""), "/+$", "")


def category_of(ext: Column) -> Column:
    return reduce(lambda out, c: F.when(ext.isin(*CATEGORIES[c]), F.lit(c)).otherwise(out), reversed(CATEGORIES), F.lit(OTHER))


def meaning_of(name: Column) -> Column:
    """By extension, else by name, else by the extension itself."""
    ext = extension_of(name)
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    generic = F.when(ext == "", F.lit("无扩展名文件")).otherwise(F.concat(F.lit("."), ext, F.lit(" 类型文件")))
    return F.coalesce(table(MEANINGS)[ext], table(NAME_MEANINGS)[F.lower(name)], generic)


#: MIME types that Python's own table may lack.
OFFICE_TYPES = {
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


def mime_of(name: Column) -> Column:
    """The MIME type by extension, from the standard table."""
    table = F.create_map(*[F.lit(x) for k, v in sorted((mimetypes.types_map | OFFICE_TYPES).items()) for x in (k[1:], v)])
    return F.coalesce(table[extension_of(name)], F.lit("application/octet-stream"))


def view_of(ext: Column) -> Column:
    """How a browser shows a file of an extension: image, video, audio, pdf, text, office or null."""
    return reduce(lambda out, v: F.when(F.lower(ext).isin(*VIEWS[v]), F.lit(v)).otherwise(out), reversed(VIEWS), F.lit(None).cast("string"))


def like_document(path: Column) -> Column:
    return F.exists(F.array(*map(F.lit, DOCUMENT_WORDS)), lambda w: F.lower(path).contains(w))


def is_system_file(name: Column) -> Column:
    return F.lower(name).isin(*SYSTEM_FILES)


def is_lock_file(name: Column) -> Column:
    return name.startswith("~$")


def in_hidden_folder(path: Column) -> Column:
    return F.exists(F.split(parent_of(path), "/"), lambda p: p.startswith("."))


def in_folder_of(path: Column, names: tuple[str, ...]) -> Column:
    """Whether a folder above is one of ``names`` (lower case)."""
    return F.exists(F.split(parent_of(path), "/"), lambda p: F.lower(p).isin(*names) if names else F.lit(False))


def needs_ocr(ratio: Column, length: Column, least_ratio: float = 0.3, least_length: int = 500) -> Column:
    """Whether a fast extraction gave too little text; nothing known: it did."""
    return F.when(ratio.isNull(), True).when(length >= least_length, False).otherwise(ratio < least_ratio)


def scan_like(image_pages: Column, pages: Column, length: Column) -> Column:
    return F.coalesce((image_pages > 0) & (pages > 0) & (length / pages < 2000), F.lit(False))


def close_to(a: Column, b: Column) -> Column:
    """Equal within 1e-6; nothing and zero are equal."""
    return F.abs(F.coalesce(a.cast("double"), F.lit(0.0)) - F.coalesce(b.cast("double"), F.lit(0.0))) < 1e-6


def iso_time(text: Column) -> Column:
    """A timestamp from ISO text; null where it is none."""
    return text.try_cast("timestamp")


def thumbnail_key(source: Column, resource: Column, file_hash: Column, width: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", source, resource, file_hash, width.cast("string")).cast("binary")), 1, 24)


def html_escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def rebased(path: Column, prefix: Column) -> Column:
    """A path relative to a prefix: the rest below it, else below it in any case, else the path itself."""
    base = F.regexp_replace(prefix, "/+$", "")
    rest = F.call_function("substr", path, F.length(base) + 2)
    return F.when(path == base, "").when(path.startswith(F.concat(base, F.lit("/"))), rest).when(F.lower(path).startswith(F.concat(F.lower(base), F.lit("/"))), rest).otherwise(path)


def byte_ranges(content: Column, ranges: Column) -> Column:
    """The bytes of (start, length) ranges one after another; null where any of them is short."""
    parts = F.transform(ranges, lambda r: F.substring(content, (r["start"] + 1).cast("int"), r["length"].cast("int")))
    whole = F.forall(ranges, lambda r: r["start"] + r["length"] <= F.octet_length(content))
    return F.when(whole, F.unhex(F.array_join(F.transform(parts, F.hex), "")))


def human_size(n: Column) -> Column:
    out = F.format_string("%.1fTB", F.bround(n / float(1 << 40), 1))
    for unit, shift in (("GB", 30), ("MB", 20), ("KB", 10)):
        out = F.when(n < 1 << (shift + 10), F.format_string(f"%.1f{unit}", F.bround(n / float(1 << shift), 1))).otherwise(out)
    return F.when(n < 1024, F.format_string("%dB", n)).otherwise(out)


def sample_spans(size: Column) -> Column:
    """The spans of a sampled fingerprint, as (start, length); null where the whole file is read."""
    return F.when(size > WHOLE, F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: F.struct(F.floor(i * (size - SPAN) / (SAMPLES - 1)).alias("start"), F.lit(SPAN).alias("length"))))


def fingerprint(text: Column) -> Column:
    """SHA-256 of a text's bytes, or of its sampled spans' bytes where it is long."""
    data = text.cast("binary")
    return F.when(F.octet_length(text) <= WHOLE, F.sha2(data, 256)).otherwise(F.sha2(byte_ranges(data, sample_spans(F.octet_length(text))), 256))


def fingerprint_algorithm(size: Column) -> Column:
    return F.when(size <= WHOLE, FULL).otherwise(SAMPLED)


def under_root(path: Column, roots: Column) -> Column:
    """Whether a path is one of the roots or lies below one; no root, and an empty one, has nothing below it."""
    p = normalised(path)
    return F.exists(roots, lambda r: (normalised(r) != "") & ((p == normalised(r)) | p.startswith(F.concat(normalised(r), F.lit("/")))))


def is_under(base: Column, target: Column, strict: bool = False) -> Column:
    below = target.startswith(F.concat(base, F.lit("/")))
    return below if strict else below | (target == base)


def stat_unchanged(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Equal size, mtime and ctime, where a ctime of 0 on either side means that nothing is known."""
    return (a["size_bytes"] == b["size_bytes"]) & (a["mtime"] == b["mtime"]) & (a["ctime"] == b["ctime"]) & (a["ctime"] != 0) & (b["ctime"] != 0)


def video_policy(path: Column, seconds: Column, folders: tuple = (), words: tuple = VIDEO_WORDS, long_minutes: int = 90) -> Column:
    """(kind, mode) of a video: by the first rule of ``folders`` (kind, part of the path, mode), then by words in the name, by length, else personal."""
    p, name = F.lower(F.translate(path, "\\", "/")), F.lower(name_of(F.translate(path, "\\", "/")))
    kind = lambda k, m: F.struct(F.lit(k).alias("kind"), F.lit(m).alias("mode"))
    out = F.when(seconds > long_minutes * 60, kind("媒体/影视", "metadata_only")).otherwise(kind("媒体/个人录像", "full"))
    for category, keys, mode in reversed(words):
        out = F.when(F.exists(F.array(*(F.lit(k.lower()) for k in keys)), lambda k: name.contains(k)), kind(category, mode)).otherwise(out)
    for category, part, mode in reversed(folders):
        out = F.when(p.contains(part.lower()), kind(category, mode)).otherwise(out)
    return out


def normalised_identity(protocol: Column, host: Column, port: Column, user: Column) -> Column:
    kind = F.lower(F.coalesce(protocol, F.lit("")))
    local = kind == "local"
    return F.struct(
        kind.alias("protocol"),
        F.when(local, F.lit("local")).otherwise(F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), "\\.+$", "")).alias("host"),
        F.when(local, F.lit(0)).otherwise(F.coalesce(port.try_cast("int"), F.lit(0))).cast("int").alias("port"),
        F.coalesce(user, F.lit("")).alias("username"),
    )


def schema_name(identity: Column) -> Column:
    """A schema's name for an identity: spelt out, or a hash of the identity where that is longer than 63 characters."""
    user = F.when(identity["username"] == "", F.lit("anon")).otherwise(F.substring(F.sha1(identity["username"].cast("binary")), 1, 12))
    plain = F.concat(F.lit("nas_"), identity["protocol"], F.lit("_"), F.regexp_replace(identity["host"], "[^a-z0-9]", "_"), F.lit("_"), identity["port"].cast("string"), F.lit("_u"), user)
    whole = F.concat_ws("|", identity["protocol"], identity["host"], identity["port"].cast("string"), identity["username"])
    return F.when(F.length(plain) > 63, F.concat(F.lit("nas_"), F.substring(F.sha1(whole.cast("binary")), 1, 24))).otherwise(plain)


def parsed_range(header: Column, size: Column) -> Column:
    """(first, last, valid) of a Range header: null first and last for the whole file.

    No header, another unit, several ranges and what is no number mean the whole file; a range
    beyond the file, an empty one and any of an empty file are invalid.
    """
    h = F.trim(F.coalesce(header, F.lit("")))
    spec = F.trim(F.call_function("substr", h, F.lit(7)))
    asked = F.lower(h).startswith("bytes=") & ~spec.contains(",")
    shape = "^\\s*([0-9]*)\\s*-\\s*(-?[0-9]*)\\s*$"
    a, b = (F.regexp_extract(spec, shape, i) for i in (1, 2))
    numbers = spec.rlike(shape) & ((a != "") | (b != "")) & (b != "-")
    first = F.when(a == "", F.greatest(F.lit(0).cast("long"), size - b.try_cast("long"))).otherwise(a.try_cast("long"))
    last = F.when((a == "") | (b == ""), size - 1).otherwise(F.least(b.try_cast("long"), size - 1))
    bad = asked & ((size <= 0) | (numbers & F.when(a == "", b.try_cast("long") <= 0).otherwise((first >= size) | (first > F.when(b == "", size - 1).otherwise(b.try_cast("long"))))))
    use = asked & numbers & ~bad
    return F.struct(F.when(use, first).alias("first"), F.when(use, last).alias("last"), (~bad).alias("valid"))


def etag(file_hash: Column, size: Column, mtime: Column) -> Column:
    return F.when(F.coalesce(file_hash, F.lit("")) != "", F.concat(F.lit('"'), file_hash, F.lit('"'))).otherwise(F.concat(F.lit('W/"'), size.cast("string"), F.lit("-"), mtime.cast("string"), F.lit('"')))
