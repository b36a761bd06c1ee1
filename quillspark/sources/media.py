"""Image, audio and video metadata from file headers, in pure Python."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from quillspark.blocks import Block, ConversionError, escape_pipe, row, size_label


def properties(title: str, cells: list[list[str]], heading: str = "") -> list[Block]:
    out = [Block("heading", f"# {title}\n\n", level=1, text=title)]
    if heading:
        out.append(Block("heading", f"## {heading}\n\n", level=2, text=heading))
    md = row(["Property", "Value"]) + "|----------|-------|\n" + "".join(map(row, cells))
    return [*out, Block("kv", md, cells=cells)]


def tag_table(heading: str, tags: list[tuple[str, str]], lead: str) -> list[Block]:
    if not tags:
        return []
    cells = [[k, escape_pipe(v)] for k, v in tags]
    return [Block("heading", f"{lead}## {heading}\n\n", level=2, text=heading), Block("kv", row(["Tag", "Value"]) + "|-----|-------|\n" + "".join(map(row, cells)), cells=cells)]


# Images


def is_svg(data: bytes) -> bool:
    head = data[:256].decode("utf-8", "replace")
    return "<svg" in head or head.startswith("<?xml")


def _png(d: bytes):
    width, height, depth, colour = struct.unpack(">IIBB", d[16:26])
    kind = {0: "L", 2: "Rgb", 3: "Rgb", 4: "La", 6: "Rgba"}[colour]
    if colour == 3 and b"tRNS" in d[:4096]:
        kind = "Rgba"
    return "Png", width, height, kind + ("16" if depth == 16 else "8")


def _jpeg(d: bytes):
    at = 2
    while at + 9 < len(d):
        if d[at] != 0xFF:
            at += 1
            continue
        mark, size = d[at + 1], struct.unpack(">H", d[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack(">HHB", d[at + 5 : at + 10])
            return "Jpeg", width, height, "L8" if parts == 1 else "Rgb8"
        at += 2 + size
    raise ValueError("no frame")


def _gif(d: bytes):
    return "Gif", *struct.unpack("<HH", d[6:10]), "Rgba8"


def _bmp(d: bytes):
    width, height = struct.unpack("<ii", d[18:26])
    return "Bmp", abs(width), abs(height), "Rgba8" if struct.unpack("<H", d[28:30])[0] == 32 else "Rgb8"


def _tiff_tags(d: bytes) -> dict[int, tuple[int, int, bytes]]:
    order = "<" if d[:2] == b"II" else ">"
    at = struct.unpack(order + "I", d[4:8])[0]
    out = {}
    for k in range(struct.unpack(order + "H", d[at : at + 2])[0]):
        tag, kind, n, value = struct.unpack(order + "HHI4s", d[at + 2 + 12 * k : at + 14 + 12 * k])
        out[tag] = kind, n, value
    return out


def _tiff(d: bytes):
    order = "<" if d[:2] == b"II" else ">"
    tags = _tiff_tags(d)
    number = lambda t, default=0: struct.unpack(order + ("H" if tags[t][0] == 3 else "I"), tags[t][2][: 2 if tags[t][0] == 3 else 4])[0] if t in tags else default
    samples = number(277, 1)
    return "Tiff", number(256), number(257), {1: "L8", 2: "La8", 3: "Rgb8"}.get(samples, "Rgba8")


def _webp(d: bytes):
    kind = d[12:16]
    if kind == b"VP8X":
        return "WebP", int.from_bytes(d[24:27], "little") + 1, int.from_bytes(d[27:30], "little") + 1, "Rgba8" if d[20] & 16 else "Rgb8"
    if kind == b"VP8L":
        bits = int.from_bytes(d[21:25], "little")
        return "WebP", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "Rgba8" if bits >> 28 & 1 else "Rgb8"
    width, height = struct.unpack("<HH", d[26:30])
    return "WebP", width & 0x3FFF, height & 0x3FFF, "Rgb8"


def exif(data: bytes) -> list[tuple[str, str]]:
    """Text and whole-number tags of the first directory of a JPEG's or TIFF's metadata."""
    # Tag numbers.
    names = {270: "ImageDescription", 271: "Make", 272: "Model", 274: "Orientation", 305: "Software", 306: "DateTime", 315: "Artist", 33432: "Copyright"}
    at = data.find(b"Exif\0\0")
    d = data[at + 6 :] if at >= 0 else data if data[:4] in (b"II*\0", b"MM\0*") else b""
    out = []
    try:
        order = "<" if d[:2] == b"II" else ">"
        for tag, (kind, n, value) in _tiff_tags(d).items() if d else ():
            if tag not in names:
                continue
            if kind == 2:
                start = struct.unpack(order + "I", value)[0]
                text = (value[:n] if n <= 4 else d[start : start + n]).split(b"\0")[0].decode("utf-8", "replace")
                shown = f'"{text}"' if text else ""
            else:
                shown = str(struct.unpack(order + "H", value[:2])[0])
            if shown and shown != "unknown":
                out.append((names[tag], shown))
    except struct.error:
        return []
    return out


def read_image(data: bytes) -> list[Block]:
    size = size_label(len(data), ("KB", "MB"))
    if is_svg(data):
        return properties("Image", [["Format", "SVG"], ["Size", size]])
    kinds = ((b"\x89PNG", _png), (b"\xff\xd8\xff", _jpeg), (b"GIF8", _gif), (b"BM", _bmp), (b"II*\0", _tiff), (b"MM\0*", _tiff))
    read = next((f for start, f in kinds if data.startswith(start)), _webp if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None)
    if read is None:
        raise ConversionError("image", "The image format could not be determined")
    try:
        name, width, height, colour = read(data)
    except (struct.error, ValueError, IndexError, KeyError) as e:
        raise ConversionError("image", f"invalid {read.__name__[1:]}: {e}") from e
    out = properties("Image", [["Format", name], ["Size", size], ["Dimensions", f"{width}x{height}"], ["Color Type", colour]])
    return out + tag_table("EXIF Metadata", exif(data), "\n")


# Audio and video


@dataclass
class Media:
    kind: str
    seconds: float = 0.0
    bitrate: int | None = None
    rate: int | None = None
    channels: int | None = None
    tags: dict[str, str] = field(default_factory=dict)


# Names of tags in the formats that have them.
VORBIS = {"TITLE": "Title", "ARTIST": "Artist", "ALBUM": "Album", "DATE": "Year", "YEAR": "Year", "TRACKNUMBER": "Track", "GENRE": "Genre", "COMMENT": "Comment", "DESCRIPTION": "Comment"}
ID3 = {"TIT2": "Title", "TPE1": "Artist", "TALB": "Album", "TYER": "Year", "TDRC": "Year", "TRCK": "Track", "TCON": "Genre", "COMM": "Comment"}
RIFF_INFO = {"INAM": "Title", "IART": "Artist", "IPRD": "Album", "ICRD": "Year", "ITRK": "Track", "IGNR": "Genre", "ICMT": "Comment"}
ATOMS = {"\xa9nam": "Title", "\xa9ART": "Artist", "\xa9alb": "Album", "\xa9day": "Year", "\xa9gen": "Genre", "\xa9cmt": "Comment"}
MPEG1_L3 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MPEG2_L3 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
MPEG_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _comments(d: bytes) -> dict[str, str]:
    n = struct.unpack("<I", d[:4])[0]
    at, out = 8 + n, {}
    for _ in range(struct.unpack("<I", d[4 + n : 8 + n])[0]):
        n = struct.unpack("<I", d[at : at + 4])[0]
        key, _, value = d[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        if key.upper() in VORBIS:
            out.setdefault(VORBIS[key.upper()], value)
        at += 4 + n
    return out


def _wav(d: bytes) -> Media:
    m, at, byte_rate, size = Media("Wav"), 12, 0, 0
    while at + 8 <= len(d):
        name, n = d[at : at + 4], struct.unpack("<I", d[at + 4 : at + 8])[0]
        body = d[at + 8 : at + 8 + n]
        if name == b"fmt ":
            _, m.channels, m.rate, byte_rate = struct.unpack("<HHII", body[:12])
        elif name == b"data":
            size = n
        elif name == b"LIST" and body[:4] == b"INFO":
            k = 4
            while k + 8 <= len(body):
                key, length = body[k : k + 4].decode("latin-1"), struct.unpack("<I", body[k + 4 : k + 8])[0]
                if key in RIFF_INFO:
                    m.tags[RIFF_INFO[key]] = body[k + 8 : k + 8 + length].split(b"\0")[0].decode("utf-8", "replace")
                k += 8 + length + length % 2
        at += 8 + n + n % 2
    if byte_rate:
        m.seconds, m.bitrate = size / byte_rate, round(byte_rate * 8 / 1000)
    return m


def _flac(d: bytes) -> Media:
    m, at = Media("Flac"), 4
    while at + 4 <= len(d):
        kind, n = d[at], int.from_bytes(d[at + 1 : at + 4], "big")
        body = d[at + 4 : at + 4 + n]
        if kind & 127 == 0:
            bits = int.from_bytes(body[10:18], "big")
            m.rate, m.channels, total = bits >> 44, (bits >> 41 & 7) + 1, bits & (1 << 36) - 1
            m.seconds = total / m.rate if m.rate else 0.0
        elif kind & 127 == 4:
            m.tags = _comments(body)
        at += 4 + n
        if kind & 128:
            break
    m.bitrate = round((len(d) - at) * 8 / m.seconds / 1000) if m.seconds else None
    return m


def _ogg(d: bytes) -> Media:
    vorbis, opus = d.find(b"\x01vorbis"), d.find(b"OpusHead")
    if vorbis >= 0:
        m = Media("Vorbis", channels=d[vorbis + 11], rate=struct.unpack("<I", d[vorbis + 12 : vorbis + 16])[0])
    elif opus >= 0:
        m = Media("Opus", channels=d[opus + 9], rate=struct.unpack("<I", d[opus + 12 : opus + 16])[0])
    else:
        raise ValueError("no known stream")
    last = d.rfind(b"OggS")
    clock = 48000 if opus >= 0 and vorbis < 0 else m.rate
    m.seconds = max(0, struct.unpack("<q", d[last + 6 : last + 14])[0]) / clock if clock else 0.0
    at = d.find(b"\x03vorbis") + 7 if vorbis >= 0 else d.find(b"OpusTags") + 8
    if at > 8:
        m.tags = _comments(d[at:])
    m.bitrate = round(len(d) * 8 / m.seconds / 1000) if m.seconds else None
    return m


def _id3(d: bytes) -> tuple[int, dict[str, str]]:
    if d[:3] != b"ID3":
        return 0, {}
    whole = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at, out = 10 + whole(d[6:10]), 10, {}
    while at + 10 <= min(end, len(d)) and d[at : at + 1].isalnum():
        name, n = d[at : at + 4].decode("latin-1"), whole(d[at + 4 : at + 8]) if d[3] == 4 else struct.unpack(">I", d[at + 4 : at + 8])[0]
        body = d[at + 10 : at + 10 + n]
        if name in ID3 and body:
            code = ("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3]
            text = body[4:] if name == "COMM" else body[1:]
            out.setdefault(ID3[name], text.decode(code, "replace").strip("\0").rpartition("\0")[2])
        at += 10 + n
    return end, out


def _mp3(d: bytes) -> Media:
    at, tags = _id3(d)
    while at + 4 <= len(d) and not (d[at] == 0xFF and d[at + 1] & 0xE0 == 0xE0 and d[at + 2] >> 4 not in (0, 15) and d[at + 2] >> 2 & 3 != 3):
        at += 1
    if at + 4 > len(d):
        raise ValueError("no frame")
    version = d[at + 1] >> 3 & 3
    kbps = (MPEG1_L3 if version == 3 else MPEG2_L3)[d[at + 2] >> 4]
    m = Media("Mpeg", bitrate=kbps, rate=MPEG_RATES[version][d[at + 2] >> 2 & 3], channels=1 if d[at + 3] >> 6 == 3 else 2, tags=tags)
    m.seconds = (len(d) - at) * 8 / (kbps * 1000)
    return m


# Sampling rates by the number that frames have for them.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def _aac(d: bytes) -> Media:
    """Frames of raw AAC, of 1024 samples each."""
    at, tags = _id3(d)
    m, frames, size = Media("Aac", tags=tags), 0, 0
    while at + 7 <= len(d) and d[at] == 0xFF and d[at + 1] & 0xF6 == 0xF0:
        if not frames:
            m.rate, m.channels = AAC_RATES[d[at + 2] >> 2 & 15], (d[at + 2] & 1) << 2 | d[at + 3] >> 6
        n = (d[at + 3] & 3) << 11 | d[at + 4] << 3 | d[at + 5] >> 5
        if n < 7:
            break
        frames, size, at = frames + 1 + (d[at + 6] & 3), size + n, at + n
    m.seconds = frames * 1024 / m.rate
    m.bitrate = round(size * 8 / m.seconds / 1000)
    return m


def _boxes(d: bytes, at: int, end: int):
    while at + 8 <= end:
        n, name, head = struct.unpack(">I", d[at : at + 4])[0], d[at + 4 : at + 8].decode("latin-1"), 8
        if n == 1:
            n, head = struct.unpack(">Q", d[at + 8 : at + 16])[0], 16
        n = n or end - at
        if n < head:
            break
        yield name, at + head, min(at + n, end)
        at += n


def _mp4(d: bytes) -> Media:
    m = Media("Mp4")

    def walk(at: int, end: int, path: str) -> None:
        for name, a, b in _boxes(d, at, end):
            if name in ("moov", "trak", "mdia", "minf", "stbl", "udta", "ilst"):
                walk(a, b, name)
            elif name == "meta":
                walk(a + 4, b, name)
            elif name == "mvhd":
                scale, length = struct.unpack(">II", d[a + 12 : a + 20]) if d[a] == 0 else struct.unpack(">IQ", d[a + 20 : a + 32])
                m.seconds = length / scale if scale else 0.0
            elif name == "stsd":
                for code, x, _ in _boxes(d, a + 8, b):
                    if code in ("mp4a", "alac", "Opus", "ac-3", "fLaC"):
                        m.channels, m.rate = struct.unpack(">H", d[x + 16 : x + 18])[0], struct.unpack(">I", d[x + 24 : x + 28])[0] >> 16
            elif path == "ilst" and name in (*ATOMS, "trkn"):
                for code, x, y in _boxes(d, a, b):
                    if code == "data":
                        m.tags["Track" if name == "trkn" else ATOMS[name]] = str(struct.unpack(">H", d[x + 10 : x + 12])[0]) if name == "trkn" else d[x + 8 : y].decode("utf-8", "replace")

    walk(0, len(d), "")
    m.bitrate = round(len(d) * 8 / m.seconds / 1000) if m.seconds else None
    return m


def probe(data: bytes, format: str) -> Media:
    kinds = ((data[:4] == b"RIFF" and data[8:12] == b"WAVE", _wav), (data[:4] == b"fLaC", _flac), (data[:4] == b"OggS", _ogg), (data[4:8] == b"ftyp", _mp4), (data[:3] == b"ID3" or data[:1] == b"\xff" and len(data) > 1 and data[1] & 0xE0 == 0xE0, _mp3))
    read = next((f for fits, f in kinds if fits), None)
    if read is _mp3 and (at := _id3(data)[0]) + 2 <= len(data) and data[at] == 0xFF and data[at + 1] & 0xF6 == 0xF0:
        read = _aac
    if read is None:  # Matroska, AVI, WMV and FLV among them
        raise ConversionError(format, "No format could be determined from the provided file")
    try:
        return read(data)
    except (struct.error, ValueError, IndexError, KeyError, TypeError, ZeroDivisionError) as e:
        raise ConversionError(format, f"invalid {read.__name__[1:]}: {e}") from e


def clock(seconds: float, hours: bool) -> str:
    s = int(seconds)
    if hours and s >= 3600:
        return f"{s // 3600}:{s % 3600 // 60:02}:{s % 60:02}"
    return f"{s // 60}:{s % 60:02}"


def _media(data: bytes, video: bool) -> list[Block]:
    m = probe(data, "video" if video else "audio")
    labels = {1: "Mono", 2: "Stereo"} | ({6: "5.1 Surround", 8: "7.1 Surround"} if video else {})
    rate = [["Audio Sample Rate" if video else "Sample Rate", f"{m.rate} Hz"]] if m.rate else []
    channels = [["Audio Channels" if video else "Channels", f"{m.channels} ({labels.get(m.channels, 'Multi-channel')})"]] if m.channels else []
    cells = [["Format", m.kind], ["Size", size_label(len(data))]]
    cells += [["Duration", clock(m.seconds, video)]] * (m.seconds > 0) + [["Bitrate", f"{m.bitrate} kbps"]] * bool(m.bitrate)
    cells += channels + rate if video else rate + channels
    out = properties("Video" if video else "Audio", cells, "File Info")
    out[-1].md += "\n"
    order = ("Title", "Artist", "Album", "Year", *(() if video else ("Track",)), "Genre", "Comment")
    return out + tag_table("Tags", [(k, m.tags[k]) for k in order if k in m.tags], "")


def read_audio(data: bytes) -> list[Block]:
    return _media(data, False)


def read_video(data: bytes) -> list[Block]:
    return _media(data, True)
