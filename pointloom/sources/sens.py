"""RGB-D streams in the ``.sens`` format, version 4: a row for each frame, images as they are."""

from __future__ import annotations

import struct

from .files import FileReader, FileSource, system


class SensReader(FileReader):
    """Options: path; every (1): keep each so-many-th frame."""

    suffix = ".sens"

    def rows(self, paths):
        every = int(self.options.get("every", "1"))
        for path in paths:
            s, p = system(path)
            with s.open_input_file(p) as f:
                take = lambda fmt: struct.unpack("<" + fmt, f.read(struct.calcsize("<" + fmt)))
                (version,) = take("I")
                if version != 4:
                    raise ValueError(f"{path}: version {version} is not 4")
                f.read(take("Q")[0])
                matrices = [list(take("16f")) for _ in range(4)]
                take("ii")
                cw, ch, dw, dh = take("IIII")
                (shift,) = take("f")
                (n,) = take("Q")
                for i in range(n):
                    pose = list(take("16f"))
                    t_color, t_depth, n_color, n_depth = take("QQQQ")
                    color, depth = f.read(n_color), f.read(n_depth)
                    if i % every == 0:
                        yield (path, i, pose, t_color, t_depth, color, depth, matrices[0], matrices[2], cw, ch, dw, dh, shift)


class SensSource(FileSource):
    reader_class = SensReader

    @classmethod
    def name(cls):
        return "sens"

    def schema(self):
        return "path string, frame_no long, camera_to_world array<float>, timestamp_color long, timestamp_depth long, color binary, depth binary, intrinsic_color array<float>, intrinsic_depth array<float>, color_width int, color_height int, depth_width int, depth_height int, depth_shift float"
